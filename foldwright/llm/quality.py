"""Quality classifier with hierarchical empirical-Bayes site posteriors.

A logistic model over text features gives each document its own evidence, a
log-likelihood ratio.  Sites form two levels, host and path within the host.  By
grouped aggregation every level gathers the evidence of its documents (a label where
there is one, else the model's probability); a path's rate is shrunk toward its host's
and a host's toward the global one.  The strength of each shrinkage is fitted by
moments from the spread of the groups' rates beyond their sampling noise, so sparse
sites keep close to their parent and large uniform sites speak for themselves.  The
path's posterior odds, without the document's own share, times the document's
likelihood ratio are its odds of being good.

The model is fitted on at most ``SAMPLE`` labelled rows (hash order of their ids);
everything else covers all rows and whole texts.  Sums by site are plain aggregates that
combine before the shuffle, and sites with more than a thousandth of all rows are
broadcast to them, so a hot host is no matter.  Null texts have no evidence, null
hosts and paths are a site of their own, rows are scored one by one, and without
labels of both kinds every document keeps the prior of one half.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_share, materialize, word_count

#: Labelled rows that the document model is fitted on.
SAMPLE = 20_000
STEPS, RIDGE = 60, 1e-3
MOST_EVIDENCE = 8.0


def features(text: Column) -> list[Column]:
    """Shares and means that don't depend on the language; each is bounded."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(word_count(t), F.lit(1)).cast("double")
    lower = F.lower(t)
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return [
        share(r"[#$%&*|!<>{}\[\]^~\\]"),
        share(r"[0-9]"),
        share(r"\p{Lu}"),
        F.least(F.regexp_count(t, F.lit(r"\s\|\s|[#$%&*!]{2,}")) / words, F.lit(1.0)),
        F.least(n / words / 20, F.lit(1.0)),
        F.least(F.log1p(words) / 12, F.lit(1.0)),
        F.size(F.array_distinct(F.split(lower, r"\s+"))) / words,
        F.size(F.array_distinct(F.split(t, "\n"))) / F.size(F.split(t, "\n")),
    ]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps: (mean, spread, weights, bias)."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - RIDGE * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w[:-1], float(w[-1])


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-count of a level by moments, from groups of (n, s) and their parent's rate."""
    r = groups.where("n > 0").agg(
        F.sum(F.pow(F.col("s") - F.col("n") * F.col(parent), F.lit(2.0)) / F.col("n")).alias("q"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("all"),
    ).first()
    if not r["noise"] or not r["all"]:
        return 1e6
    # E[q] = sum v_g (1 + (n_g - 1) rho) with rho the correlation inside groups
    rho = min(0.99, max(1e-6, (r["q"] - r["noise"]) / max(1e-9, r["all"] - r["noise"])))
    return (1 - rho) / rho


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score (probability of quality 1) and keep of every row."""
    votes = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.avg("quality").alias("label"))
    xs = features(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").isNotNull().alias("has"), *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)])
    base = base.join(votes, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    base = materialize(base, "quality-features")
    seen = base.where(F.col("label").isNotNull() & F.col("has"))
    rows = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "x0").limit(SAMPLE).select("label", *[f"x{i}" for i in range(len(xs))]).toArrow()
    y = (rows.column(0).to_numpy() >= 0.5).astype(float) if rows.num_rows else np.zeros(0)
    if 0 < y.sum() < len(y):
        mean, spread, w, bias = _fit(np.column_stack([rows.column(i + 1).to_numpy() for i in range(len(xs))]), y)
        own_rate = float(y.mean())
        rate = float(base.where(F.col("label").isNotNull()).agg(F.avg((F.col("label") >= 0.5).cast("double"))).first()[0])
        logit = F.lit(bias)
        for i in range(len(xs)):
            logit = logit + (F.col(f"x{i}") - float(mean[i])) * float(w[i] / spread[i])
        prior = float(np.log(rate / (1 - rate)))
        # the fitted bias holds the sample's odds
        evidence = F.least(F.greatest(logit - float(np.log(own_rate / (1 - own_rate))), F.lit(-MOST_EVIDENCE)), F.lit(MOST_EVIDENCE))
    else:
        rate, prior, evidence = 0.5, 0.0, F.lit(0.0)
    base = base.withColumn("evidence", F.when(F.col("has"), evidence).otherwise(0.0))
    base = base.withColumn("own", F.coalesce("label", 1 / (1 + F.exp(-(F.col("evidence") + prior)))))
    base = base.withColumns({"host": F.coalesce("host", F.lit("\u0000")), "path": F.coalesce("path", F.lit("\u0000"))})

    paths = materialize(base.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("global", F.lit(rate))
    k_host = _strength(hosts, "global")
    hosts = hosts.withColumn("host_rate", (F.col("s") + k_host * F.col("global")) / (F.col("n") + k_host)).select("host", "host_rate")
    paths = materialize(paths.join(hosts, "host"), "quality-hosts")
    k_path = _strength(paths, "host_rate")
    joined = join_by_share(base, paths, ["host", "path"], "n")
    # a document doesn't vote on itself
    path_rate = (F.col("s") - F.col("own") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(path_rate / (1 - path_rate)))))
    return joined.select("doc_id", "evidence", "host_rate", path_rate.alias("path_rate"), score.alias("score"), (score >= 0.5).alias("keep"))
