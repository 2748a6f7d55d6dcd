"""Mixing overlapping sources to target weights by min-cost flow.

Documents are grouped by membership pattern (the sorted set of sources that hold
them).  Words flow from patterns to source quotas; passing a pattern's words a
second time costs more than the first, so the cost of repetition is convex and
the flow repeats only where a quota can't be met from fresh words.  The flow runs
on the driver over one node per pattern and source, never over documents.  The
words routed out of each pattern are then turned into documents: whole passes over
the pattern, and the remainder as a prefix of a seeded order.

Null texts have no words and are never taken; a null source is a source of its
own, last in order; repeated rows are documents of their own with equal seeds, told
apart by their place in the input.  Very long texts count whole, and the mix is off a
target by one document at most.  An empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_share, materialize, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_PASSES = 2
#: Buckets of the seeded order: only the bucket in which a pattern's cut lies is sorted.
SEED_BUCKETS = 4096
#: Sources and patterns live on the driver; more than this raises instead of exhausting it.
MAX_PATTERNS = 100_000


def targets(sizes: dict, weights: dict, budget: float = BUDGET, cap: float = MAX_PASSES) -> dict:
    """Share ``budget * total`` by weight; what would pass ``cap * size`` is shared again by weight."""
    left, open_, out = budget * sum(sizes.values()), dict(weights), {}
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > cap * sizes[s]]
        if not full:
            return out | {s: unit * w for s, w in open_.items()}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def route(patterns: list[tuple[tuple, int]], quotas: dict, passes: int = MAX_PASSES) -> list[dict]:
    """Min-cost flow from patterns to quotas; returns words per source for each pattern.

    The k-th pass over a pattern costs k for a word.  Successive shortest paths
    with arcs source-of-flow -> pattern (one per pass), pattern -> source, source
    -> sink.
    """
    names = list(quotas)
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, k, d in ((a, b, cap, c), (b, a, 0, -c)):
            head[x].append(len(to))
            to.append(y), room.append(k), cost.append(d)
        return len(to) - 2

    links = []
    for i, (members, words) in enumerate(patterns):
        for k in range(passes):
            arc(0, 1 + i, words, k + 1)
        links.append({s: arc(1 + i, at[s], passes * words, 0) for s in members if s in at})
    for s in names:
        arc(at[s], sink, int(quotas[s]), 0)
    level = [0] * (sink + 1)  # potentials keep reduced costs non-negative
    while True:
        far, via = {0: 0}, {}
        queue, settled = [(0, 0)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in settled:
                continue
            settled.add(x)
            for e in head[x]:
                if room[e] > 0 and (nd := d + cost[e] + level[x] - level[to[e]]) < far.get(to[e], 1 << 62):
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(queue, (nd, to[e]))
        if sink not in far:
            break
        for x, d in far.items():
            level[x] += min(d, far[sink])
        for x in range(len(level)):
            if x not in far:
                level[x] += far[sink]
        push, x = 1 << 62, sink
        while x:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return [{s: room[e ^ 1] for s, e in found.items()} for found in links]


def mix(docs: DataFrame, memberships=None, weights=WEIGHTS, budget: float = BUDGET, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pattern, size, source_size, target, passes, taken for every document.

    ``memberships`` is a column with the array of sources of a document; the
    default is its one ``source``.  ``source_size`` and ``target`` are those of its
    first source.  ``taken`` is ``passes * size`` and never above ``2 * size``.  The ``keep``
    columns of ``docs`` follow.
    """
    spark = docs.sparkSession
    member = memberships if memberships is not None else F.array(F.col("source").cast("string"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.array_sort(F.array_distinct(member)), F.array(F.lit(None).cast("string"))).alias("pattern"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).alias("seeded"),
        F.monotonically_increasing_id().alias("at"),
        *keep,
    )
    base = materialize(base.withColumn("bucket", F.pmod(F.col("seeded"), F.lit(SEED_BUCKETS)).cast("int")), "mix-sizes")
    by_bucket = materialize(base.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-buckets")
    found = by_bucket.groupBy("pattern").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; coarsen the sources")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    sizes: dict = defaultdict(int)
    for r in found:
        for s in r["pattern"]:
            sizes[s] += r["words"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal = targets({s: sizes[s] for s in names}, weight, budget) if names else {}
    quota = {s: int(goal[s] + 0.5) for s in names}
    routed = route([(tuple(r["pattern"]), r["words"]) for r in found], quota)
    plan = []
    for r, flow in zip(found, routed):
        out, words, first = sum(flow.values()), r["words"], r["pattern"][0]
        whole, part = (min(MAX_PASSES, out // words), out % words if out < MAX_PASSES * words else 0) if words else (0, 0)
        plan.append((r["pattern"], int(whole), int(part), int(sizes[first]), float(goal[first])))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.createDataFrame([(p[0], p[2]) for p in plan], "pattern array<string>, part long")
    cuts = (
        by_bucket.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .join(parts, "pattern")
        .where((F.col("before") < F.col("part")) & (F.col("before") + F.col("words") >= F.col("part")))
        .groupBy("pattern").agg(F.min("bucket").alias("cut"), F.min("before").alias("before_cut"))
    )
    cut = {tuple(r["pattern"]): (r["cut"], r["before_cut"]) for r in cuts.collect()}
    # a row per pattern
    plans = spark.createDataFrame(
        [(*p, *cut.get(tuple(p[0]), (None, None)), r["n"]) for p, r in zip(plan, found)],
        "pattern array<string>, whole long, part long, source_size long, target double, cut int, before_cut long, n long",
    )
    joined = join_by_share(base, plans, "pattern", "n")
    # only the rows of each pattern's cut bucket are put in order
    border = joined.where(F.col("bucket") == F.col("cut"))
    run = Window.partitionBy("pattern").orderBy("seeded", "doc_id", "at")
    border = border.withColumn("upto", F.col("before_cut") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # the document at the cut is taken if most of it lies before the cut
    extra_border = (F.col("upto") * 2 - F.col("size") <= F.col("part") * 2).cast("long")
    rest = joined.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
    extra_rest = F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0).cast("long")
    cols = ["doc_id", "pattern", "size", "source_size", "target", *keep]
    both = border.select(*cols, (F.col("whole") + extra_border).alias("passes")).unionAll(rest.select(*cols, (F.col("whole") + extra_rest).alias("passes")))
    return both.withColumn("taken", F.col("passes") * F.col("size"))
