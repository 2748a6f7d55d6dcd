import numpy as np
import pytest

from foldwright.llm import hashing_ann, voronoi_knn


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score string")


def sample(n=1200, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    x[50:70] = x[min(49, n - 1)]  # copies tie
    return x


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in r], 0, "s") for i, r in enumerate(x)]


ODD = [(5000, None, 0, "s"), (5100, [float("nan")] * 16, 0, "s"), (5200, [float("inf")] + [0.0] * 15, 0, "s"), (5300, [None] + [0.0] * 15, 0, "s"), (None, [1.0] * 16, 0, "s"), (5401, [0.5], 0, "s"), (5500, [0.0] * 16, 0, "s")]


@pytest.mark.parametrize("search", [voronoi_knn.top_inner_products, hashing_ann.nearest_neighbours])
def test_repeated_rows_are_rows(spark, search):
    """Each copy of a query gets a list, and the other copies stand in it."""
    rows = rows_of(sample(250))
    rows += rows[:5] + rows[100:105]
    got = [tuple(r) for r in search(table(spark, rows)).collect()]
    x = np.array([r[1] for r in rows])
    whole = np.floor(1024 * x)
    want = []
    for q in (i for i, r in enumerate(rows) if r[0] % 100 == 0):
        exact = search is voronoi_knn.top_inner_products
        score = whole @ whole[q] if exact else -np.sqrt(((x - x[q]) ** 2).sum(1))
        order = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-score[i], rows[i][0]))[:10]
        want += [(rows[q][0], n + 1, rows[i][0]) for n, i in enumerate(order)]
    assert len(got) == len(want) == 50
    if search is voronoi_knn.top_inner_products:
        assert sorted(g[:3] for g in got) == sorted(want)
    else:
        assert len(set(g[:3] for g in got) & set(want)) >= 0.8 * len(set(want))
    assert [g[1:3] for g in got if g[0] == 100].count((1, 100)) == 2 * (search is hashing_ann.nearest_neighbours or (1, 100) in [w[1:] for w in want if w[0] == 100])


@pytest.mark.parametrize("block", [8192, 100])
def test_voronoi_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi_knn, "DATA_BLOCK", block)
    monkeypatch.setattr(voronoi_knn, "QUERY_BLOCK", max(2, block // 50))
    x = sample()
    got = {}
    for r in voronoi_knn.top_inner_products(table(spark, rows_of(x) + ODD), n_pivots=12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.append(np.arange(len(x)), [5401, 5500])
    full = np.vstack([x, [[0.5] + [0] * 15], np.zeros((1, 16))]).astype(np.float64)
    f = np.floor(1024 * full).astype(np.int64)
    for q in np.flatnonzero(ids % 100 == 0):
        s, other = f @ f[q], ids != ids[q]
        top = np.lexsort((ids[other], -s[other]))[:10]
        assert sorted(got[ids[q]]) == [(i + 1, ids[other][t], s[other][t]) for i, t in enumerate(top)]
    assert set(got) == {q for q in ids.tolist() if q % 100 == 0}


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(8, 4)) * 50
    x = np.repeat(pivots, 200, 0) + rng.normal(size=(1600, 4))
    near = np.argmin(((x[:, None] - pivots) ** 2).sum(2), 1)
    far = np.sqrt(((x - pivots[near]) ** 2).sum(1))
    cells = {c: (int((near == c).sum()), far[near == c].max()) for c in range(8) if (near == c).any()}
    wanted = voronoi_knn.floors(pivots, cells, cells, 10)
    assert sum(map(len, wanted.values())) < len(cells) ** 2
    for i in range(0, 1600, 37):
        top = np.argsort(-(x @ x[i]))[:10]
        assert set(near[top]) <= set(wanted[near[i]])


def test_large_products_do_not_wrap():
    a = np.array([[2.0**40, 3.0]])
    assert voronoi_knn.multiply(a, a)[0, 0] == 2**63 - 1
    b = np.array([[2.0**28, 3.0]])
    assert voronoi_knn.multiply(b, b)[0, 0] == 2**56 + 9


@pytest.mark.parametrize("block", [8192, 150])
def test_hashing_recall(spark, monkeypatch, block):
    monkeypatch.setattr(hashing_ann, "DATA_BLOCK", block)
    x = sample(1500, 16, 5)
    got = {}
    for r in hashing_ann.nearest_neighbours(table(spark, rows_of(x) + ODD)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 100):
        gap = np.sqrt(((full - full[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), gap)) if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(s == pytest.approx(gap[v], abs=1e-9) for _, v, s in mine if v < 1500)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(order))
    assert hits >= 0.9 * 150
    assert 5500 not in got and 5000 not in got


def test_few_rows(spark):
    few = table(spark, rows_of(sample(4)))
    assert hashing_ann.nearest_neighbours(few).count() == 3
    assert voronoi_knn.top_inner_products(few).count() == 3
    for empty in (few.limit(0), few.where("vec_id = 1")):
        assert hashing_ann.nearest_neighbours(empty).count() == 0
        assert voronoi_knn.top_inner_products(empty).count() == 0


def test_pigeonhole_finds_all_codes():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 256, (3000, 4)).astype(np.uint8)
    block = hashing_ann.Block(np.arange(3000), rng.normal(size=(3000, 3)), codes)
    for radius in (0, 3, 7, 12, 32):
        for q in range(5):
            want = np.flatnonzero(hashing_ann.hamming(codes, codes[q]) <= radius)
            assert (block.within(codes[q], radius) == want).all()
