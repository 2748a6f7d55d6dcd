"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_scratch: dict[str, SparkSession] = {}
#: Paths of the tables written inside :func:`only_last`.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where none is set and all is in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not str(spark.sparkContext.master).startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "foldwright-checkpoints")
    return found


def _sweep(path: str) -> None:
    spark = _scratch.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by now; the folder is scratch space
        pass


def sweep() -> None:
    """Remove all scratch tables now; results that still read them must have been written."""
    for path in list(_scratch):
        _sweep(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives the reader
    column statistics and pruning, which an RDD checkpoint would not.  The
    files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/foldwright-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(sweep)
    _scratch[path] = spark
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def only_last(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, the last table that it wrote; the tables written on the way there are removed."""
    token = _written.set([])
    try:
        df = make()
        for path in _written.get()[:-1]:
            _sweep(path)
    finally:
        _written.reset(token)
    return df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are over.

    It does so when the driver's garbage is collected, for which a small heap gives no cause while disks fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors give memory back that earlier steps needed: a heap shrinks only when it is collected as a whole."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("x")).write.format("noop").mode("overwrite").save()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of ``rows`` rows for queries that run inside, as several are held at once, by Spark and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """``df`` and ``__row``, a number that tells its rows apart and is the same whenever they are read again.

    Rows of a Parquet path are numbered by file and place in it, and nothing is written; any other table is written once.
    """
    import pyarrow as pa

    plan = df._jdf.queryExecution().analyzed()
    name = lambda x: x.getClass().getSimpleName()
    if name(plan) == "LogicalRelation" and name(plan.relation()) == "HadoopFsRelation" and name(plan.relation().fileFormat()) == "ParquetFileFormat":
        if plan.relation().location().rootPaths().size() == 1:  # a path given twice has its rows twice
            file, at = (df.metadataColumn("_metadata").getField(c) for c in ("file_path", "row_index"))
            files = sorted(r[0] for r in df.select(file.alias("f")).distinct().collect())
            numbers = pa.table([pa.array(files, pa.string()), pa.array(range(len(files)), pa.int64())], names=["__file", "__n"])
            numbers = df.sparkSession.createDataFrame(numbers)  # from Arrow no Python worker is needed
            own = df.select(*[df[c] for c in df.columns], file.alias("__file"), at.alias("__at"))
            return own.join(F.broadcast(numbers), "__file").select(*df.columns, (F.shiftleft("__n", 40) + F.col("__at")).alias("__row"))
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()), tag)


def salted_join(many: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``many`` joined to ``few``, which has a row a key, with every key's rows spread over ``salts`` tasks."""
    spread = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [on, "__salt"], how).drop("__salt")


def join_by_share(many: DataFrame, few: DataFrame, on, rows: str, share: int = 1000) -> DataFrame:
    """``many`` left-joined to ``few``, which has a row a key with the number ``rows`` of its rows in ``many``.

    Keys that hold more than a ``share``-th of all rows, of which there are fewer than ``share``,
    are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    total = few.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = F.broadcast(few.where(F.col(rows) * share > total))
    rest = many.join(hot.select(on), on, "left_anti").join(few.where(F.col(rows) * share <= total), on, "left")
    return rest.unionByName(many.join(hot, on))


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote, if this is one; nothing may read it afterwards."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [k for k in _scratch if path.endswith(k.split(":", 1)[-1].lstrip("/"))]:
            _sweep(known)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Number of runs of bytes other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bucket_of(doc_id, modulus: int) -> F.Column:
    """crc32 of the id written in decimal, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- word hashing

#: Odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: dict[int, np.ndarray] = {}


def release() -> None:
    """Give a Python worker's free memory back; for the end of a task's rows."""
    import ctypes

    import pyarrow as pa

    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        return


def text_slices(batch, at: int, chars: int):
    """(part of the batch, its texts in column ``at``): rows of about ``chars`` characters together, one at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chars, side="right")))
        part = batch.slice(i, j - i)
        yield part, part.column(at).to_pylist()
        i = j


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; tables of up to 2 MB entries are kept."""
    have = _tables.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 21:
            _tables[int(base)] = have
    return have[:n]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, salt: int = 0):
    """Hash every word of a column of UTF-8 texts.

    ``data`` is the byte buffer, ``offsets`` the text bounds in it.  Returns
    ``(hashes, first)``: a 64-bit hash per word in order, ASCII letters folded to
    lower case, and for text ``i`` the words ``first[i]:first[i+1]``.
    """
    hashes, bounds = [], [np.zeros(1, np.int64)]
    done, i, n = 0, 0, len(offsets) - 1
    while i < n:  # slices of a MB keep the temporaries, and the tables of powers, small
        j = int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1
        j = min(n, max(j, i + 1))
        piece = _FOLD[data[int(offsets[i]) : int(offsets[j])]]
        local = np.asarray(offsets[i : j + 1], np.int64) - int(offsets[i])
        is_word = _IS_WORD[piece]
        inner = is_word.copy()  # a word goes on unless a text begins here
        if len(inner):
            inner[1:] &= is_word[:-1]
            inner[0] = False
            inner[local[:-1][local[:-1] < len(inner)]] = False
        begin = np.flatnonzero(is_word & ~inner)
        ends_here = is_word.copy()
        if len(inner):
            ends_here[:-1] &= ~inner[1:]
        end = np.flatnonzero(ends_here) + 1
        value = _BYTE[piece] ^ np.uint64(salt & (2**64 - 1)) if salt else _BYTE[piece]
        value = np.where(is_word, value, np.uint64(0))
        value *= _powers(_BASE, len(piece))
        np.cumsum(value, out=value)
        total = value[end - 1] - np.where(begin > 0, value[begin - 1], np.uint64(0))
        total *= _powers(_BASE_INV, len(piece))[begin]
        hashes.append(mix64(total + (end - begin).astype(np.uint64)))
        bounds.append(np.searchsorted(begin, local[1:]) + done)
        done += len(begin)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def text_buffer(column):
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets
