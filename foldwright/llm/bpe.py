"""Byte-level BPE by a hierarchical-bitmap rank queue.

Pre-tokens are doubly linked lists of byte symbols, laid end to end with a wall after
each, so that one queue serves many of them.  Each merge rank has a bucket with the list
positions whose pair has that rank.  A two-level bitmap marks the ranks whose bucket is
not empty: find-first-set on the upper level, then on the word below it, gives the
lowest rank in constant time.  Positions in a bucket whose pair has changed since are
stale and are skipped.  A bucket is merged as a whole, from left to right where its
pairs overlap; what a merge makes can only be followed by pairs with the new token,
which are looked up among that token's partners.  Every merge costs constant time, so
n bytes take O(n) queue steps however long a pre-token is, and there is no limit on
length.

In most rank tables a pair with a new token ranks behind it.  Where one ranks before it,
the rest of a bucket has to wait, so such a pre-token is merged one position at a time,
by a queue of its own that looks for the lowest rank again after every merge.

Null and empty texts have no ids.  Special tokens are ordinary text.  Letters and
numbers are those of the ``regex`` module's Unicode version.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, text_slices

#: Pre-tokens up to so many characters are remembered, and at most twice so many of them.
CACHE_CHARS, CACHE_SIZE = 40, 120_000
#: Characters of text that are encoded together, and symbols in one queue.
TEXT_CHARS, QUEUE_SYMBOLS = 4 << 20, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Partners:
    """Tokens that merge with a token on one side of it, and the ranks of the merged."""

    def __init__(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray, size: int):
        order = np.lexsort((other, own))
        self.other, self.rank = other[order], rank[order]
        self.start = np.searchsorted(own[order], np.arange(size + 1)).tolist()

    def __call__(self, token: int, others: np.ndarray) -> np.ndarray | None:
        """Rank of the pair with each of ``others``, -1 for none; None if the token has no partner."""
        a, b = self.start[token], self.start[token + 1]
        if a == b:
            return None
        at = np.searchsorted(self.other[a:b], others)
        at[at == b - a] = 0
        at += a
        return np.where(self.other[at] == others, self.rank[at], -1)


class _Ranks:
    """The set of ranks that have a bucket: two levels of bits, 256 ranks a word."""

    def __init__(self, size: int):
        self.low, self.top = [0] * ((size >> 8) + 1), 0

    def add(self, rank: int) -> None:
        word = rank >> 8
        if not self.low[word]:
            self.top |= 1 << word
        self.low[word] |= 1 << (rank & 255)

    def take(self) -> int:
        """Remove and return the lowest; only while ``top`` isn't zero."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        bit = bits & -bits
        self.low[word] = bits ^ bit
        if bits == bit:
            self.top ^= 1 << word
        return word << 8 | bit.bit_length() - 1


class Codec:
    """Encodes and decodes with one rank table; needs nothing but the table and the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.text_of = {str(i): t for t, i in ranks.items()}
        self.spelt = {i: str(i) for i in ranks.values()}
        pairs = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int32).reshape(-1, 3)
        self.right = _Partners(pairs[:, 0], pairs[:, 1], pairs[:, 2], self.size)
        self.left = _Partners(pairs[:, 1], pairs[:, 0], pairs[:, 2], self.size)
        #: Ranks of pairs of bytes, the wall (256) with none.
        self.first = np.full((257, 257), -1, np.int32)
        for t, r in ranks.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [x for _, ids in self.encode_many([piece]) for x in ids] if piece else []

    def encode_many(self, pieces: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place, ids) of every non-empty pre-token, in any order."""
        queue, n = [], 0
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                yield i, [whole]
                continue
            if n + len(p) > QUEUE_SYMBOLS and queue:
                yield from zip(queue, self._merge([pieces[q] for q in queue]))
                queue, n = [], 0
            queue.append(i)
            n += len(p) + 1
        if queue:
            yield from zip(queue, self._merge([pieces[q] for q in queue]))

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Merge all the pieces with one queue."""
        sizes = np.array([len(p) for p in pieces])
        start = np.cumsum(sizes + 1) - sizes - 1
        raw = np.full(int(sizes.sum()) + len(pieces), 256, np.int32)
        inside = np.ones(len(raw), bool)
        inside[start + sizes] = False
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.append(self.byte_id, np.int32(-1))[raw]
        rank_at = np.full(len(raw), -1, np.int32)
        rank_at[:-1] = self.first[raw[:-1], raw[1:]]
        after, before = np.arange(1, len(raw) + 1, dtype=np.int32), np.arange(-1, len(raw) - 1, dtype=np.int32)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = _Ranks(self.size)
        early: list[np.ndarray] = []

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                cuts = [0, *cuts.tolist(), len(at)]
            else:
                cuts = [0, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                r = int(ranks[a])
                have = buckets.get(r)
                if have is None:
                    buckets[r] = [at[a:b]]
                    queue.add(r)
                else:
                    have.append(at[a:b])

        held = np.flatnonzero(rank_at >= 0).astype(np.int32)
        if len(held):
            push(held, rank_at[held])
        del raw, inside, held
        while queue.top:
            rank = queue.take()
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank_at[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            other = after[at]
            touch = other[:-1] == at[1:]
            if touch.any():  # of overlapping pairs every second one, from the left
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), place, 0))
                keep = (place - begin) % 2 == 0
                at, other = at[keep], other[keep]
            beyond = after[other]
            close = beyond[:-1] == at[1:]
            if close.any():  # between two merges side by side there is a pair for a moment
                passing = self.right(rank, ids[beyond[:-1][close]])
                if passing is not None and ((passing >= 0) & (passing < rank)).any():
                    early.append(at[:-1][close][(passing >= 0) & (passing < rank)])
            ids[at], ids[other], after[at], before[beyond] = rank, -1, beyond, at
            rank_at[other] = -1
            found = self.right(rank, ids[after[at]])
            rank_at[at] = -1 if found is None else found
            prior = before[at]  # the first position's is the last wall
            back = self.left(rank, ids[prior])
            rank_at[prior] = -1 if back is None else back
            new = [(x[r >= 0], r[r >= 0]) for x, r in ((at, found), (prior, back)) if r is not None]
            for x, r in new:
                if len(x):
                    push(x, r)
                    if int(r.min()) < rank:
                        early.append(x[r < rank])
        alive = ids >= 0
        bounds = np.cumsum([0, *np.add.reduceat(alive, start, dtype=np.int64).tolist()]).tolist()
        flat = ids[alive].tolist()
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.unique(np.searchsorted(start, np.concatenate(early), side="right") - 1).tolist() if early else ():
            out[i] = self._merge_singly(pieces[i])
        return out

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        """Every pair of tokens that makes a token, and that token's rank."""
        return {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}

    def _merge_singly(self, piece: bytes) -> list[int]:
        """As :meth:`_merge`, a position at a time; a bucket's rest waits while a lower rank is there."""
        n, rank_of = len(piece), self.merged.get
        ids = [*self.byte_id[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        buckets: dict[int, list[int]] = {}
        queue = _Ranks(self.size)

        def push(i: int) -> None:
            r = rank_of((ids[i], ids[after[i]]))
            if r is not None:
                if r not in buckets:
                    buckets[r] = []
                    queue.add(r)
                heappush(buckets[r], i)

        for i in range(n - 1):
            push(i)
        while queue.top:
            rank = queue.take()
            bucket = buckets[rank]
            i = heappop(bucket)
            if bucket:
                queue.add(rank)
            else:
                del buckets[rank]
            j = after[i]
            if ids[i] < 0 or rank_of((ids[i], ids[j])) != rank:
                continue  # stale
            k = after[j]
            ids[i], ids[j], after[i], before[k] = rank, -1, k, i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode_texts(self, texts: list[str | None]) -> list[str]:
        """Every text's ids as decimals joined by commas."""
        lists = [self.split(t) if t else () for t in texts]
        known, older = self.known, self.older
        own = dict.fromkeys(chain.from_iterable(lists))
        new = []
        for w in own:
            have = known.get(w) or older.get(w)
            if have is None:
                new.append(w)
            else:
                own[w] = have
        spell = self.spelt.__getitem__
        for i, ids in self.encode_many([w.encode("utf-8", "replace") for w in new]):
            own[new[i]] = ",".join(map(spell, ids))
        if len(known) >= CACHE_SIZE:  # what is met again moves to the new half
            self.older, self.known = known, {}
        room = 2 * CACHE_SIZE - len(self.known)
        for w, out in own.items():
            if len(w) <= CACHE_CHARS and room > 0:
                self.known[w] = out
                room -= 1
        return [",".join(map(own.__getitem__, pieces)) for pieces in lists]

    def encode(self, text: str) -> list[int]:
        joined = self.encode_texts([text])[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids) -> bytes:
        return self.decode_joined(",".join(map(str, ids)))

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, joined.split(","))) if joined else b""


_codecs: dict[str, tuple[dict, Codec]] = {}


def _codec_of(shared, pattern: str) -> Codec:
    """The Python worker's codec, kept from task to task while the broadcast table is the same."""
    table, codec = _codecs.get(pattern, (None, None))
    if table is not shared.value:
        table, codec = _codecs[pattern] = shared.value, Codec(shared.value, pattern)
    return codec


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep=("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """The ``keep`` columns, n_tokens and, as asked, the ids (array<int>) and digests.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes
    that the ids decode to.  The rank table (under a MB, its size does not depend on
    the data) is read on the driver and broadcast.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(rank_path))
    keep = list(keep)
    at = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else len(keep)
    kept = [docs.schema[c] for c in keep]
    fields = [T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared, pattern)
        gc.disable()  # millions of small objects, none of them in cycles
        for whole in batches:
            for batch, texts in text_slices(whole, at, TEXT_CHARS):
                joined = codec.encode_texts(texts)
                n = np.array([j.count(",") + 1 if j else 0 for j in joined], np.int64)
                columns = [batch.column(i) for i in range(len(keep))]
                columns.append(pa.array(n))
                if ids:
                    flat = np.fromstring(",".join(j for j in joined if j), np.int32, sep=",") if n.any() else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), flat))
                if digests:
                    columns.append(pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()))
                    columns.append(pa.array([hashlib.sha256(codec.decode_joined(j)).hexdigest() for j in joined], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[f.name for f in fields]])
        gc.enable()
        release()

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + fields)
    extra = [] if at < len(keep) else [F.col("text").cast("string").alias("__text")]
    return docs.select(*keep, *extra).mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, rank_path: str, ids_column: str = "ids") -> DataFrame:
    """All columns and ``decoded`` (binary); null ids decode to no bytes."""
    import pyarrow as pa

    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(rank_path).items()})
    names = encoded.columns
    place = names.index(ids_column)

    def decoded(batches):
        for batch in batches:
            table = shared.value
            out = [b"".join(map(table.__getitem__, x)) if x else b"" for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(decoded, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
