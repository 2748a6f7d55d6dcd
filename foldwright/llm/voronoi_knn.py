"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, a bounded sample of the data, cut the space into cells.  Every cell is
summarised by its number of rows, its radius about the pivot, and its longest row.
For a group of queries about pivot p within r and a data cell about pivot c within R,
every inner product lies within ``p.c -+ (r |c| + R |p| + r R)``.  Counting cells from
the best lower bound down until k candidates (and the query itself) are sure gives each
query group a floor; a cell whose upper bound is below the floor can't matter and gets
no copy of the group's queries.  The remaining pairs of query blocks and data blocks
are solved locally, each block holding a bounded number of rows, and the blocks' lists
are merged by query.

Cells are split into blocks by a hash of the id, so a hot cell spreads over many
tasks.  Summaries have one row a pivot.  Where nothing can be pruned, as for directions
without structure in many dimensions, every query block meets every data block once.

Components are floor(scale * x); scores are exact (integer arithmetic wherever
doubles would not be).  Vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; shorter vectors are filled with zeros.  Repeated rows and ids are rows of their own:
each query row gets a list, in which all other rows take part.  Scores beyond the range of a long are its
ends, and tie.
"""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import DATA_BLOCK, QUERY_BLOCK, best, is_query, matrix, top_rows, usable

#: Pivots are as many rows as the root of their number, between these bounds; so their table has under 10 million numbers.
N_PIVOTS, MOST_PIVOTS = 64, 4096
#: Room for rounding in the bounds; sizes and distances are summed in double precision.
SLACK = 1e-9


def floors(pivots: np.ndarray, data: dict, queries: dict, k: int) -> dict[int, list[int]]:
    """Query cell -> the data cells that can hold one of its queries' k best.

    ``data`` and ``queries``: cell -> (rows, radius).
    """
    norms, out = np.sqrt((pivots**2).sum(1)), {}
    cells = sorted(data)
    for q, (_, r) in queries.items():
        centre = pivots[q] @ pivots[cells].T
        radius = np.array([data[c][1] for c in cells])
        give = r * norms[cells] + radius * norms[q] + r * radius
        give += SLACK * (np.abs(centre) + give + 1)
        low, high = centre - give, centre + give
        need, floor = k + 1, -np.inf  # one more, as the query itself may be counted
        for j in np.argsort(-low, kind="stable"):
            need -= data[cells[j]][0]
            if need <= 0:
                floor = low[j]
                break
        out[q] = [c for c, h in zip(cells, high) if h >= floor]
    return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as int64 (beyond it, the nearest int64)."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).dot(np.array([[int(x) for x in row] for row in b], object).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_inner_products(table: DataFrame, k: int = 10, scale: int = 1024, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row."""
    import pyarrow as pa

    spark = table.sparkSession
    rows = usable(table).select("at", "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    rows = materialize(rows, "voronoi-rows")
    width, n_rows = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    n_pivots = n_pivots or min(MOST_PIVOTS, max(N_PIVOTS, isqrt(n_rows)))
    empty = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], empty)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toArrow()
    pivots = matrix(sample.column("v"), width)
    _, first = np.unique(pivots, axis=0, return_index=True)
    pivots = pivots[np.sort(first)]

    def assigned(batches):
        lengths = (pivots**2).sum(1)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            near = np.argmin(lengths - 2 * (x @ pivots.T), 1)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["at", "vec_id", "v", "cell", "far"])

    rows = materialize(rows.mapInArrow(assigned, "at long, vec_id long, v array<double>, cell int, far double"), "voronoi-cells")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count_if(is_query(F.col("vec_id"))).alias("nq"), F.max(F.when(is_query(F.col("vec_id")), F.col("far"))).alias("rq")).collect()
    data = {c["cell"]: (c["n"], c["r"]) for c in cells}
    queries = {c["cell"]: (c["nq"], c["rq"]) for c in cells if c["nq"]}
    if not queries:
        return spark.createDataFrame([], empty)
    wanted = floors(pivots, data, queries, k)

    # a bundle is a run of small query cells, or a part of a large one, of about QUERY_BLOCK queries
    order = sorted(queries)
    ends = list(accumulate(queries[q][0] for q in order))
    first_bundle = {q: (e - queries[q][0]) // QUERY_BLOCK for q, e in zip(order, ends)}
    parts = {q: max(1, -(-queries[q][0] // QUERY_BLOCK)) for q in order}
    bundle = lambda q, h: first_bundle[q] + h % parts[q]
    blocks = {c: -(-n // DATA_BLOCK) for c, (n, _) in data.items()}
    met: dict[int, set[int]] = {}  # data cell -> bundles that need it
    for q in order:
        for c in wanted[q]:
            met.setdefault(c, set()).update(bundle(q, h) for h in range(parts[q]))

    plan = spark.sparkContext.broadcast((first_bundle, parts, wanted, blocks, {c: sorted(b) for c, b in met.items()}))  # pivots x (pivots + bundles) numbers

    def dealt(batches):
        first, split, wanted, size, meets = plan.value
        for batch in batches:
            ids, cell, rows = (batch.column(c).to_numpy() for c in ("vec_id", "cell", "at"))
            h = ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
            some, held = [], 0
            for part in pairs(ids, cell, h, first, split, wanted, size, meets):
                some.append(part)
                held += len(part[0])
                if held >= 20_000:
                    yield emit(batch, some)
                    some, held = [], 0
            if some:
                yield emit(batch, some)

    def pairs(ids, cell, h, first, split, wanted, size, meets):
        """Rows with the bundle, block and role that they go to."""
        for c in np.unique(cell).tolist():
            own = np.flatnonzero(cell == c)
            for b in meets.get(c, ()):  # the cell's rows, once for each bundle of queries that needs it
                yield own, np.full(len(own), b), (c << 32) + h[own] % size[c], np.zeros(len(own), bool)
            asked = own[ids[own] % 100 == 0]
            if len(asked):
                to = first[c] + h[asked] % split[c]
                for d in wanted[c]:
                    for j in range(size[d]):
                        yield asked, to, np.full(len(asked), (d << 32) + j), np.ones(len(asked), bool)

    def emit(batch, some):
        at, to, block, query = (np.concatenate(x) for x in zip(*some))
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("at", "vec_id", "v")], pa.array(to, pa.int64()), pa.array(block, pa.int64()), pa.array(query)], names=["at", "vec_id", "v", "bundle", "block", "query"])

    def solved(t: pa.Table) -> pa.Table:
        is_q = t.column("query").to_numpy(zero_copy_only=False)
        rows, ids, x = t.column("at").to_numpy(), t.column("vec_id").to_numpy(), matrix(t.column("v"), width)
        q_rows, q_ids, q, d_rows, d_ids, d = rows[is_q], ids[is_q], x[is_q], rows[~is_q], ids[~is_q], x[~is_q]
        out = [[], [], [], []]
        for i in range(0, len(q) if len(d) else 0, 256):
            for q_row, q_id, row in zip(q_rows[i : i + 256], q_ids[i : i + 256], multiply(q[i : i + 256], d)):
                other = np.flatnonzero(d_rows != q_row)
                top = other[top_rows(row[other], d_ids[other], k)]
                for o, x in zip(out, (np.full(len(top), q_row), np.full(len(top), q_id), d_ids[top], row[top])):
                    o.append(x)
        flat = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
        return pa.table(flat, names=["at", "query_id", "vec_id", "score"])

    dealt_rows = rows.select("at", "vec_id", "v", "cell").mapInArrow(dealt, "at long, vec_id long, v array<double>, bundle long, block long, query boolean")
    found = dealt_rows.groupBy("bundle", "block").applyInArrow(solved, "at long, query_id long, vec_id long, score long")
    return best(found, k, descending=True)
