"""Any mergeable fold by its derived merge: partial states in Python, then merged by key.

Rows are range-partitioned by the order, each partition folds its rows from the zero
(one state a key and partition), and the states of a key are merged in the order of their
partitions.  Only states cross the shuffle.  For aggregates that no built-in form covers.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import Fold, Ty
from ..lang.evaluate import compile_expr, Lst, Map
from ..synth.derive import derive_merge

#: Keys whose states a task holds before it passes them on.
MOST_KEYS = 50_000


def to_value(v, t: Ty):
    """A row value from Arrow's Python form."""
    if t.kind == "tuple":
        parts = list(v.values()) if isinstance(v, dict) else list(v)
        return tuple(to_value(x, a) for x, a in zip(parts, t.args))
    if t.kind == "list":
        return Lst(to_value(x, t.args[0]) for x in v)
    if t.kind == "set":
        return frozenset(to_value(x, t.args[0]) for x in v)
    if t.kind == "map":
        return Map((to_value(k, t.args[0]), to_value(x, t.args[1])) for k, x in (v.items() if isinstance(v, dict) else v))
    return v


def merged_states(df: DataFrame, fold: Fold, key: str, row: str, order: str, partitions: int | None = None) -> DataFrame:
    """(key, state): ``state`` is the printed final state of every group."""
    import pyarrow as pa

    d = derive_merge(fold)
    if d.merge is None:
        raise ValueError(f"{fold.name} has no merge; evaluate it in order")
    target = d.lifted or fold
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(order).alias("ord")).repartitionByRange(n, "ord").sortWithinPartitions("ord")
    ranged = ranged.withColumn("part", F.spark_partition_id().cast("long"))
    kind = ranged.schema["key"].dataType

    def partial(batches):
        step, zero = compile_expr(target.acc)({}), compile_expr(target.init)({})
        states: dict = {}
        batch_no = part = 0

        def flush():
            nonlocal batch_no
            batch_no += 1
            keys = list(states)
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([part] * len(keys), pa.int64()), pa.array([batch_no] * len(keys), pa.int64()), pa.array([pickle.dumps(states[k]) for k in keys], pa.binary())], names=["key", "part", "seq", "state"])
            states.clear()
            return out

        for batch in batches:
            part = batch.column(3)[0].as_py() if batch.num_rows else part
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                states[k] = step(states.get(k, zero))(to_value(v, target.row))
            if len(states) > MOST_KEYS:
                yield flush()
        if states:
            yield flush()

    schema = T.StructType([T.StructField("key", kind), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("state", T.BinaryType())])

    def final(t: pa.Table) -> pa.Table:
        merge, state = compile_expr(d.merge)({}), None
        for row in sorted(t.select(["part", "seq", "state"]).to_pylist(), key=lambda r: (r["part"], r["seq"])):
            s = pickle.loads(row["state"])
            state = s if state is None else merge(state)(s)
        if d.lifted is not None:
            state = state[0]
        return pa.table({"key": t.column("key").slice(0, 1), "state": pa.array([repr(state)])})

    out = T.StructType([T.StructField("key", kind), T.StructField("state", T.StringType())])
    return ranged.mapInArrow(partial, schema).groupBy("key").applyInArrow(final, out)
