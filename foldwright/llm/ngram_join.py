"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity.

A document's set holds its distinct shingles of ``k`` lower-cased words (the whole
sequence, if it has fewer words); documents link when their sets' Jaccard similarity
is at least ``percent``/100.  Exact: no signature is dropped and no list is capped.

*Light sets* (at most ``boundary`` shingles) are joined on enumerated subsets: linked
sets share their intersection, which misses at most ``n - ceil(percent * n / 100)``
members of either, so each emits its subsets of those sizes.  *Heavy sets* are joined
on inverted lists.  A list's key is not one shingle, as passages that many documents
share would make such lists quadratic, but the content of one block of a hash
partition of the set: linked sets of sizes up to u differ in at most
``H = 2u (100 - percent) / (100 + percent)`` shingles, so of more than H blocks one is
equal in both.  Sizes are cut into ranges so that linked sets lie in the same or the
next one.  Blocks that hold nothing but popular shingles would chain all texts with a
common passage, so a set with more than H other blocks emits only those: one of them is
equal in any linked set.  Which shingles count as popular changes only the work, never
the links.  Sets near the boundary emit both kinds.  The boundary minimises the number
of keys, weighed, over the measured sizes.

Lists only elect a leader (the least member), which gives one edge a member, not all
pairs.  Connected candidates are then checked exactly: a candidate group's inverted
lists are scanned breadth first, each document against those not reached yet, so a
tight group of near copies costs about one scan.  A group above ``GROUP_SHINGLES`` is
dealt in chunks over many tasks, in two rounds: first each chunk with some pivots that all
chunks get, which joins nearly all of a true group; then the documents outside the
group's largest component (in chunks, too) with every chunk, so that each pair that could
still join two components meets in some task.

Equal sets are one node throughout.  Nodes are 128-bit digests; shingles are 64-bit
hashes.  Null and empty texts have empty sets and link with nothing; a row without an
id can link others but has no name to give.  Repeated rows are equal sets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_shuffles, join_by_share, materialize, mix64, release, salted_join, small_batches, text_buffer, words_of
from .graph import connected_components

#: A list key of a heavy set costs so many times one of a light set: it may need checking in vain.
HEAVY_WEIGHT = 1.5
#: Sets up to this size may be light.
LIGHT_MOST = 40
#: Shingles that one task checks at once (8 bytes each, and the lists over them).
GROUP_SHINGLES = 1_500_000
#: Pivots that every chunk of a large group gets, about.
PIVOTS = 32
#: Bits of the filter that spares unlinked documents the last shuffle; its size is fixed.
FILTER_BITS = 1 << 24
#: Popular shingles are looked for in one row of so many, and so many are kept (1 MB).
POPULAR_SHARE, POPULAR_MOST = 16, 100_000
#: Sets that a task remembers, to emit the keys of copies only once.
SEEN = 100_000

#: A shingle's word ``i`` is weighed by the i-th power of the first; the others tell sums apart.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow column."""
    words, first = words_of(*text_buffer(column))
    n = len(words)
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    weights = np.cumprod(np.full(max(k, 1), _MULT[0]), dtype=np.uint64)
    for i in range(k):
        grams += words[i : n - k + 1 + i] * weights[i] if len(grams) else grams
    grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            whole = words[a:b] * weights[: b - a]
            out.append(mix64(whole.sum(keepdims=True, dtype=np.uint64) + _MULT[[7]] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set and its size."""
    sums = np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ _MULT[1]).sum(dtype=np.uint64)], np.uint64)
    x = mix64(sums + _MULT[:2] * np.uint64(len(s))).view(np.int64)
    return int(x[0]), int(x[1])


class Keys:
    """Which keys a set of each size emits, for one threshold and boundary."""

    def __init__(self, percent: int, boundary: int = 0, popular: np.ndarray | None = None):
        self.percent, self.boundary = percent, boundary
        self.popular = np.zeros(0, np.uint64) if popular is None else popular
        self.lows, self.highs, self.parts, self.differ, self.edges = [1], [self.most(1)], [], [], {}

    def least(self, n: int) -> int:
        """The smallest overlap, and partner, that a set of n can have."""
        return -(-self.percent * n // 100)

    def most(self, n: int) -> int:
        return 100 * n // self.percent

    def range_of(self, n: int) -> int:
        while self.highs[-1] < self.most(n) + 1:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(self.most(self.lows[-1]))
        return int(np.searchsorted(self.highs, n))

    def blocks(self, i: int) -> tuple[int, int]:
        """(H, number of blocks) of range i.

        More blocks than H + 1, as some are empty: so many that of the smallest sets that
        use the range nearly all have over H blocks that aren't.
        """
        while len(self.parts) <= i:
            j = len(self.parts)
            self.range_of(self.highs[j] + 1)
            h = 2 * self.highs[j] * (100 - self.percent) // (100 + self.percent)
            smallest = self.least(self.lows[j])
            parts = h + 1
            while parts - (empty := parts * exp(-smallest / parts)) - 3.5 * sqrt(empty) < h + 1 and parts < smallest:
                parts += 1
            self.differ.append(h)
            self.parts.append(parts)
        return self.differ[i], self.parts[i]

    def ranges(self, n: int) -> list[int]:
        i = self.range_of(n)
        return [i, i + 1] if self.most(n) > self.highs[i] else [i]

    def n_subsets(self, n: int) -> int:
        return sum(comb(n, j) for j in range(n - self.least(n) + 1))

    def cost(self, counts: dict[int, int], boundary: int) -> float:
        return sum(c * ((self.n_subsets(n) if self.least(n) <= boundary else 0) + (HEAVY_WEIGHT * sum(self.blocks(i)[1] for i in self.ranges(n)) if n > boundary else 0)) for n, c in counts.items())

    def of(self, s: np.ndarray) -> list[np.ndarray]:
        """The keys of a sorted set."""
        n, out = len(s), []
        if not n:
            return out
        mixed = mix64(s)
        if self.least(n) <= self.boundary:
            total, found = mixed.sum(keepdims=True, dtype=np.uint64), []
            for j in range(n - self.least(n) + 1):
                gone = np.array(list(combinations(range(n), j)), np.int64).reshape(comb(n, j), j)
                found.append(mix64((total - mixed[gone].sum(1, dtype=np.uint64)) + np.uint64(n - j)))
            out += found
        if n > self.boundary:
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
            rare = np.ones(n, bool)
            if len(self.popular):
                rare = self.popular[np.minimum(np.searchsorted(self.popular, s), len(self.popular) - 1)] != s
            rares = np.concatenate([[0], np.cumsum(rare)])
            for i in self.ranges(n):
                differ, parts = self.blocks(i)
                if i not in self.edges:
                    cuts = np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)
                    self.edges[i] = cuts, mix64(np.arange(parts, dtype=np.uint64) + (np.uint64(i + 1) << np.uint64(32)))
                cuts, salt = self.edges[i]
                at = np.concatenate([[0], np.searchsorted(s, cuts), [n]])
                key = mix64((sums[at[1:]] - sums[at[:-1]]) ^ salt)
                # with more than H such blocks, a linked set has one of them too
                for told in (np.diff(rares[at]) > 0, np.diff(at) > 0):
                    if told.sum() > differ:
                        key = key[told]
                        break
                out.append(key)
        return out


def _scan(docs: DataFrame, k: int, handle, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text); ``handle(ids, sets, seen)`` gives the columns of some rows."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                columns = handle(piece.column(0), shingle_sets(piece.column(1), k), seen)
                if len(seen) > SEEN:
                    seen.clear()
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _node(a: int, b: int) -> bytes:
    return a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True)


def sized(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, node (128-bit digest of the set), short (its first half)."""
    import pyarrow as pa

    def handle(ids, sets, seen):
        found = [digest(s) for s in sets]
        return [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(*d) for d in found], pa.binary()), pa.array([d[0] for d in found], pa.int64())]

    return _scan(docs, k, handle, "doc_id long, n_shingles long, node binary, short long")


def keyed(docs: DataFrame, k: int, keys: Keys, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, short) of every set, of the ``part``-th of ``parts`` of all keys; a set that a task meets again emits nothing more.

    A key that several sets of a slice share goes on with the least of them alone; the others are
    tied to it by a key of the two of them.  So a key has a row a slice at most, however many sets share it.
    """
    import pyarrow as pa

    def handle(ids, sets, seen):
        out, owners = [], []
        for s in sets:
            a, _ = digest(s)
            if not len(s) or a in seen:
                continue
            seen.add(a)
            own = keys.of(s)
            if parts > 1:
                own = [o[o % np.uint64(parts) == part] for o in own]
            out += own
            owners += [a] * len(own)
        if not out:
            return None
        key, short = np.concatenate(out), np.repeat(np.array(owners, np.int64), [len(o) for o in out])
        order = np.lexsort((short, key))
        key, short = key[order], short[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        if not first.all():
            leader = short[np.flatnonzero(first)[np.cumsum(first) - 1]]
            tied = np.unique(np.stack([leader, short], 1)[~first & (leader != short)], axis=0)
            own = mix64(mix64(tied[:, 0].view(np.uint64).copy()) + tied[:, 1].view(np.uint64).copy())
            key, short = np.concatenate([key[first], own, own]), np.concatenate([short[first], tied[:, 0], tied[:, 1]])
        return [pa.array(key.view(np.int64)), pa.array(short)]

    return _scan(docs, k, handle, "key long, short long")


def popular_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The shingles most often met in a sixteenth of the rows, at least thrice; sorted."""
    import pyarrow as pa

    def handle(ids, sets, seen):
        return [pa.array(np.concatenate(sets).view(np.int64))] if sets else None

    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(POPULAR_SHARE)) == 0)
    counts = _scan(sample, k, handle, "shingle long").groupBy("shingle").count().where("count >= 3")
    found = counts.orderBy(F.desc("count"), "shingle").limit(POPULAR_MOST).toArrow()
    return np.sort(found.column("shingle").to_numpy().view(np.uint64))


def link_groups(group, percent: int) -> list[tuple[bytes, bytes]]:
    """Exact components of some sets: (node, root) for each node that links to another.

    Breadth-first: the inverted lists of a document's shingles are scanned and the
    overlaps with the documents not yet reached counted; the lists are rebuilt
    whenever half of those are gone.
    """
    nodes, sets = group
    n_docs = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n_docs), sizes)
    n_ids = int(ids.max()) + 1
    alive = np.ones(n_docs, bool)

    def lists():
        keep = alive[owner]
        own, tok = owner[keep], ids[keep]
        order = np.argsort(tok, kind="stable")
        return own[order], np.searchsorted(tok[order], np.arange(n_ids + 1)), int(alive.sum())

    posting, start, built = lists()
    out, left = [], n_docs
    for seed in np.argsort(-sizes, kind="stable"):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        queue, root, found = [int(seed)], nodes[int(seed)], False
        while queue and left:
            d = queue.pop()
            if left * 2 < built:
                posting, start, built = lists()
            own = ids[bounds[d] : bounds[d + 1]]
            lo, hi = start[own], start[own + 1]
            n = hi - lo
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            shared = np.bincount(posting[at], minlength=n_docs)
            near = np.flatnonzero(alive & (100 * shared >= percent * (sizes + sizes[d] - shared)) & (shared > 0))
            for x in near.tolist():
                out.append((nodes[x], root))
                found = True
            alive[near] = False
            left -= len(near)
            queue += near.tolist()
        if found:
            out.append((root, root))
        if not left:
            break
    return out


def candidate_edges(docs: DataFrame, k: int, keys: Keys, part: int = 0, parts: int = 1) -> DataFrame:
    """(u, v): the sets of each list with its leader."""
    leader = keyed(docs, k, keys, part, parts).withColumn("leader", F.expr("min(short) OVER (PARTITION BY key)"))
    return leader.where(F.col("leader") != F.col("short")).select(F.col("short").alias("u"), F.col("leader").alias("v"))


def join(docs: DataFrame, k: int = 4, percent: int = 85, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    The lists are made in ``rounds`` by their keys, each with that part of the shuffled rows, for so many scans of the texts.
    """
    with small_batches(docs.sparkSession):  # all that runs Python is written here
        return _join(docs, k, percent, rounds)


def _join(docs: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    import pyarrow as pa

    spark = docs.sparkSession
    sizes = materialize(sized(docs, k), "ngram-sizes")
    counts = {r["n"]: r["c"] for r in sizes.where((F.col("n_shingles") > 0) & (F.col("n_shingles") <= 2 * LIGHT_MOST)).groupBy(F.col("n_shingles").alias("n")).agg(F.count_distinct("short").alias("c")).collect()}
    keys = Keys(percent, popular=popular_shingles(docs, k))
    keys.boundary = min(range(LIGHT_MOST + 1), key=lambda x: (keys.cost(counts, x), x)) if counts else 0

    edges, written = candidate_edges(docs, k, keys, 0, rounds), []
    if rounds > 1:
        for i in range(rounds):
            free_shuffles(spark)
            written.append(materialize(candidate_edges(docs, k, keys, i, rounds).distinct(), "ngram-edges"))
        edges = reduce(DataFrame.unionAll, written)
    free_shuffles(spark)
    groups = materialize(connected_components(edges, "ngram-candidates"), "ngram-groups").withColumnsRenamed({"node": "short", "label": "grp"})
    for df in written:
        drop_table(df)
    free_shuffles(spark)

    nodes = sizes.where("n_shingles > 0").groupBy("node", "short", "n_shingles").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "ngram-nodes")
    weight = groups.join(nodes, "short").groupBy("grp").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("docs"))
    large = weight.where(F.col("w") > GROUP_SHINGLES).select("grp", F.ceil(F.col("w") * 2 / GROUP_SHINGLES).cast("int").alias("chunks"), "docs")
    weighed = salted_join(groups, large, "grp", "short", "left")
    groups = materialize(weighed.select("short", "grp", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce("docs", F.lit(1)).alias("docs")), "ngram-weighed")

    # a bit filter of fixed size tells most tasks' rows that no one will ask for their set
    bit = F.pmod(F.col("short"), F.lit(FILTER_BITS))
    bits = groups.select(bit.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()
    mask = np.zeros(FILTER_BITS // 64, np.uint64)
    mask[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(mask)  # 2 MB, whatever the input

    def handle(ids, sets, seen):
        m, rows = shared.value, []
        for s in sets:
            if not len(s):
                continue
            a, b = digest(s)
            p = a % FILTER_BITS
            if int(m[p >> 6]) >> (p & 63) & 1 and (a, b) not in seen:
                seen.add((a, b))
                rows.append((a, _node(a, b), s.tobytes()))
        if not rows:
            return None
        return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]

    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("mine")
    members = _scan(docs, k, handle, "short long, node binary, members binary").join(groups, "short").select("grp", "node", "members", "chunks", "docs", mine)
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def checked(table: pa.Table) -> pa.Table:
        found = dict(zip(table.column("node").to_pylist(), table.column("members").to_pylist()))
        linked = link_groups((list(found), [np.frombuffer(m, np.uint64) for m in found.values()]), percent) if len(found) > 1 else []
        release()
        grp, split = len(linked) * [table.column("grp")[0].as_py()], len(linked) * [table.column("chunks")[0].as_py() > 1]
        return pa.table([pa.array(grp, pa.int64()), pa.array([x for x, _ in linked], pa.binary()), pa.array([r for _, r in linked], pa.binary()), pa.array(split, pa.bool_())], names=["grp", "u", "v", "split"])

    links = "grp long, u binary, v binary, split boolean"
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("docs")) < PIVOTS)
    first = members.withColumn("part", F.explode(F.when(pivot, upto(F.col("chunks"))).otherwise(F.array("mine"))))
    stars = materialize(first.groupBy("grp", "part").applyInArrow(checked, links), "ngram-links")
    free_shuffles(spark)
    whole = stars.where(~F.col("split")).select(F.col("u").alias("node"), F.col("v").alias("label"))
    large = groups.where("chunks > 1")
    if large.limit(1).count():
        so_far = stars.where("split").select("u", "v")
        within = nodes.join(large, "short").select("grp", "node", "n_shingles")
        within = materialize(within.join(connected_components(so_far, "ngram-first"), "node", "left").withColumn("label", F.coalesce("label", "node")), "ngram-within")
        largest = within.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        rest = materialize(salted_join(within, largest, "grp", "node").where(F.col("label") != F.col("main")), "ngram-rest")
        rest_chunks = rest.groupBy("grp").agg(F.ceil(F.sum("n_shingles") * 2 / GROUP_SHINGLES).cast("int").alias("rests"))
        told = salted_join(members.where("chunks > 1"), rest_chunks, "grp", "node").join(rest.select("node", F.lit(True).alias("outside")), "node", "left")
        as_chunk = told.withColumn("part", F.col("mine")).withColumn("rest", F.explode(upto(F.col("rests"))))
        as_rest = told.where("outside").withColumn("part", F.explode(upto(F.col("chunks")))).withColumn("rest", F.pmod(F.xxhash64("node", F.lit(2)), F.col("rests")).cast("int"))
        second = as_chunk.unionByName(as_rest).groupBy("grp", "part", "rest").applyInArrow(checked, links)
        whole = whole.unionAll(connected_components(so_far.unionAll(second.select("u", "v")), "ngram-split"))
    whole = materialize(whole, "ngram-whole")
    least = whole.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component"))
    component = salted_join(whole, least, "label", "node").select("node", "component")
    own = nodes.select("node", "least", "copies").join(component, "node", "left").select("node", F.coalesce("component", "least").alias("component"), "copies")
    rows = sizes.select("doc_id", "n_shingles", "node")
    found = join_by_share(rows.where("n_shingles > 0"), materialize(own, "ngram-own"), "node", "copies").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.unionAll(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
