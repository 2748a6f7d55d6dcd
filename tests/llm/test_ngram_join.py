import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foldwright.llm import graph, ngram_join
from foldwright.llm.ngram_join import Keys


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def corpus(rng, n=150):
    words = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(n):
        w = rng.choices(words, k=rng.choice([1, 2, 3, 4, 6, 9, 12, 20, 40, 150, 400]))
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w[at:at] = passage
        if texts and rng.random() < 0.5:
            w = re.findall(r"\S+", rng.choice(texts) or "x")
            for _ in range(rng.randrange(1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((" " if i % 3 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in w))
    return texts + [None, "", " \t\n", texts[0], texts[0], "é" * 5, "é" * 5]


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 85, 3)])
def test_exact_components(spark, k, percent, seed):
    texts = corpus(random.Random(seed))
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, component_id bigint, node string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, k, percent).collect()}
    sizes, roots = brute(texts, k, percent)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_null_ids_repeats_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "other words here"), (None, "lonely")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_join.join(docs).collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (9, 1, 9), (None, 1, None)], key=str)
    assert ngram_join.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [0, 2, 32])
def test_large_groups_are_split(spark, monkeypatch, pivots):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 60, 3)] + [" ".join(base)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    _, roots = brute(texts, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == dict(enumerate(roots))


@pytest.mark.parametrize("percent", [80, 85, 95])
@pytest.mark.parametrize("boundary", [0, 13])
def test_linked_sets_share_a_key(percent, boundary):
    rng = random.Random(percent)
    popular = np.sort(np.array([rng.getrandbits(64) for _ in range(500)], np.uint64))
    keys = Keys(percent, boundary, popular)
    for _ in range(400):
        n = max(1, rng.choice([1, 3, 6, 8, 13, 14, 16, 30, 100, 400]) + rng.randrange(-2, 3))
        share = rng.choice([0, 0.3, 0.95])
        a = {int(rng.choice(popular)) if rng.random() < share else rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for x in rng.sample(sorted(a), int(len(a) * rng.random() * (100 - percent) / 100)):
            b.discard(x) if rng.random() < 0.5 else b.add(rng.getrandbits(64))
        if b and 100 * len(a & b) >= percent * len(a | b):
            own, other = (set(np.concatenate(keys.of(np.array(sorted(s), np.uint64))).tolist()) for s in (a, b))
            assert own & other


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in up}


def test_hashing_is_the_same_for_any_slicing():
    texts = pa.array(["A b  c d e", None, "", "é\tb\x0bC", "long " * 500])
    whole = ngram_join.shingle_sets(texts, 2)
    for i in range(len(texts)):
        assert (ngram_join.shingle_sets(texts.slice(i, 1), 2)[0] == whole[i]).all()
