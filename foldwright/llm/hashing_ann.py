"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, rotated by learned orthogonal maps (iterative
quantisation) and cut at zero.  A code is cut into byte-sized substrings, each with
an index of its own from value to rows.  Two codes within Hamming distance r agree
within floor(r / m) bits in one of the m substrings at least, so probing that small
ball in every index returns every code within r (pigeonhole); candidates are confirmed
by their full Hamming distance and reranked by exact Euclidean distance.

The index is sharded: each block of rows, dealt by a hash of the id, is indexed where it
is searched, and all query rows visit all blocks, so every row is indexed and no list is
cut.  The radius is learned: the distance within which ``RECALL_AIM`` of the true
neighbours in the sample lie.  A block in which a query finds fewer than k codes is
probed again with a larger radius, up to all codes, so every query gets k results if
there are so many rows.

Mean, rotations and radius are fitted on a sample of ``SAMPLE`` rows (hash order of the
id), whatever the input.  Null and zero vectors and those with null or non-finite
components take no part, nor do rows without an id; shorter vectors are filled with zeros.
Repeated rows and ids are rows of their own: each query row gets a list, in which all other rows take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import DATA_BLOCK, best, is_query, matrix, top_rows, usable

#: Rows that the codes are fitted on, and the queries among them that the radius is.
SAMPLE, SAMPLE_QUERIES = 4096, 256
CODE_BITS = 256
RECALL_AIM = 0.97
ROUNDS = 12
#: Queries a block takes at once.
QUERY_SLICE = 2048

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BY_WEIGHT = np.argsort(_POP, kind="stable").astype(np.uint8)
_BALL = np.searchsorted(np.sort(_POP), np.arange(9), side="right")


class Codes:
    """Learned rotated binary codes of ``bits`` bits."""

    def __init__(self, sample: np.ndarray, bits: int = CODE_BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x, d = sample - self.mean, sample.shape[1]
        turns = []
        for _ in range(-(-bits // d)):
            r, _ = np.linalg.qr(rng.standard_normal((d, d)))
            for _ in range(ROUNDS):  # the rotation that best fits the signs, and again
                u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = (u @ vt).T
            turns.append(r)
        self.turn = np.concatenate(turns, 1)[:, : -(-bits // 8) * 8]
        short = -self.turn.shape[1] % 8
        self.turn = np.pad(self.turn, ((0, 0), (0, short)))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn >= 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POP[a ^ b].sum(-1, dtype=np.int32)


def learn(sample: np.ndarray, k: int) -> tuple[Codes, int]:
    codes = Codes(sample)
    packed, far = codes.of(sample), []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        gap = ((sample - sample[i]) ** 2).sum(1)
        gap[i] = np.inf
        far.append(hamming(packed[np.argsort(gap)[: min(k, len(sample) - 1)]], packed[i]))
    far = np.concatenate(far) if far else np.zeros(0)
    return codes, int(np.quantile(far, RECALL_AIM)) if len(far) else 0


class Block:
    """The substring indexes of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, at: np.ndarray | None = None):
        self.ids, self.rows, self.codes, self.at = ids, rows, codes, ids if at is None else at
        self.order = np.argsort(codes, 0, kind="stable").T.copy()
        self.start = np.stack([np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within ``radius``: pigeonhole probing, then the full distance."""
        m = len(self.order)
        seen = np.zeros(len(self.ids), bool)
        whole, rest = divmod(radius, m)
        for j in range(m):
            # of m shares of radius, the first rest + 1 may have whole bits, the others fewer
            reach = min(8, whole if j <= rest else whole - 1)
            if reach < 0:
                break
            values = _BY_WEIGHT[: _BALL[reach]] ^ code[j]
            lists = np.zeros(256, bool)
            lists[values] = True
            # values in order: neighbouring lists lie next to each other
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lists.view(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2]):
                seen[self.order[j, self.start[j, a] : self.start[j, b]]] = True
        found = np.flatnonzero(seen)
        return found[hamming(self.codes[found], code) <= radius]

    def nearest(self, own: int, query: np.ndarray, code: np.ndarray, radius: int, k: int):
        bits, wanted = 8 * len(self.order), min(k, int((self.at != own).sum()))
        while True:
            found = self.within(code, radius)
            found = found[self.at[found] != own]
            if len(found) >= wanted or radius >= bits:
                break
            radius = min(bits, radius + max(2, bits // 32))
        gap = np.sqrt(((self.rows[found] - query) ** 2).sum(1))
        top = top_rows(-gap, self.ids[found], k)
        return self.ids[found[top]], gap[top]


def nearest_neighbours(table: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance of each query row."""
    import pyarrow as pa

    spark = table.sparkSession
    rows = materialize(usable(table).where(F.exists("v", lambda x: x != 0)), "ann-rows")
    stats = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("nq")).first()
    if not stats["nq"] or stats["n"] < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = stats["width"]
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("v"), width)
    shared = spark.sparkContext.broadcast(learn(sample, k))  # bits x width numbers
    n_blocks = max(1, -(-stats["n"] // DATA_BLOCK))
    n_bundles = max(1, -(-stats["nq"] // QUERY_SLICE))
    query = is_query(F.col("vec_id"))
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    # queries meet every block; a block meets every slice of the queries
    as_data = rows.select("at", "vec_id", "v", dealt.alias("block"), F.explode(upto(n_bundles)).alias("bundle"), F.lit(False).alias("query"))
    as_query = rows.where(query).select("at", "vec_id", "v", F.explode(upto(n_blocks)).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(n_bundles)).alias("bundle"), F.lit(True).alias("query"))

    def searched(t: pa.Table) -> pa.Table:
        codes, radius = shared.value
        is_q = t.column("query").to_numpy(zero_copy_only=False)
        at, ids, x = t.column("at").to_numpy(), t.column("vec_id").to_numpy(), matrix(t.column("v"), width)
        out = [[], [], [], []]
        if is_q.any() and not is_q.all():
            packed = codes.of(x)
            block = Block(ids[~is_q], x[~is_q], packed[~is_q], at[~is_q])
            for i in np.flatnonzero(is_q):
                found, gap = block.nearest(at[i], x[i], packed[i], radius, k)
                for o, y in zip(out, (np.full(len(found), at[i]), np.full(len(found), ids[i]), found, gap)):
                    o.append(y)
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(f.astype(np.int64)) for f in flat[:3]] + [pa.array(flat[3].astype(np.float64))], names=["at", "query_id", "vec_id", "score"])

    found = as_data.unionAll(as_query).groupBy("bundle", "block").applyInArrow(searched, "at long, query_id long, vec_id long, score double")
    return best(found, k, descending=False)
