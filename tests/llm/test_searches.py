"""Exact and approximate search against brute force."""
import numpy as np
import pytest

from arealytics.llm import hash_search, pivot_search

NAN = float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, block string")


def cloud(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype(np.float32)
    v[n // 2: n // 2 + n // 4] = v[0] + 0.01 * v[n // 2: n // 2 + n // 4]  # one crowded spot
    v[5] = v[6] = v[7]
    return v


ODD = [(9001, None), (9002, [1.0, None]), (9003, [NAN] * 16), (9004, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]


def exact(rows, every, k):
    ints = {i: np.floor(np.array(v, np.float64) * 1024).astype(int) for i, v in rows}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        got = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(got)]
    return out


def test_exact_search_equals_brute_force(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(cloud(700))]
    got = sorted(tuple(r) for r in pivot_search.search(vectors(spark, rows + ODD), k=10, every=50, pivots=4).collect())
    assert got == exact(rows, 50, 10)


def test_exact_search_with_repeats_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [])]
    got = sorted(tuple(r) for r in pivot_search.search(vectors(spark, rows), k=10, every=100).collect())
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2), (3, 3)]
    assert pivot_search.search(vectors(spark, []), k=3).collect() == []


def test_products_stay_exact_beyond_doubles():
    left = np.array([[2 ** 30, 1]]), np.array([[2 ** 30, 1]])
    assert pivot_search.products(*left)[0, 0] == 2 ** 60 + 1


def test_probes_meet_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    for radius in (0, 3, 7, 8, 12, 20):
        limits = np.array(hash_search.reaches(radius))
        for _ in range(300):
            flips = rng.choice(64, radius, replace=False)
            away = np.bincount(flips // 8, minlength=8)
            assert (away <= limits).any()


def test_hash_search_recall_and_scores(spark):
    v = cloud(900, 32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9010, [0.0] * 32)]
    got = hash_search.search(vectors(spark, rows + ODD), k=5, every=30).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit, asked = 0, 0
    for q in range(0, 900, 30):
        near = u @ u[q]
        near[q] = -2
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(near[r["vec_id"]], abs=1e-12) for r in own)
        hit += len({r["vec_id"] for r in own} & set(np.argsort(-near, kind="stable")[:5].tolist()))
        asked += 5
    assert hit / asked >= 0.9


def test_hash_search_finds_all_when_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])]
    got = hash_search.search(vectors(spark, rows), k=5, every=50).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]
    assert hash_search.search(vectors(spark, [])).collect() == []
