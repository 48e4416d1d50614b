"""Nearest neighbours found against brute force; scores, ties, copies and edge cases."""

import numpy as np
import pytest

from assayer.llm import nn_descent, queries


def brute_force(rows, every, k):
    vectors = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in vectors:
        if q % every == 0:
            scored = [(float(vectors[q] @ v / np.linalg.norm(vectors[q]) / np.linalg.norm(v)), i) for i, v in vectors.items() if i != q]
            out[q] = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_force(rows, 50, 5)
    got = {}
    for r in queries.LLM_QUERIES["op7_nn_descent"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    found = 0
    for q, best in want.items():
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(best) + 1))
        found += len({v for _, v, _ in got[q]} & {i for _, i in best})
        vectors = dict(rows)
        for _, v, score in got[q]:
            x, y = np.array(vectors[q], float), np.array(vectors[v], float)
            assert np.isclose(score, x @ y / np.linalg.norm(x) / np.linalg.norm(y), rtol=0, atol=1e-12)
    assert found >= 0.97 * sum(map(len, want.values()))


@pytest.mark.parametrize("noise", [1e-2, 1e-3])
def test_recall_in_a_tight_group_of_near_copies(spark, noise):
    draw = np.random.default_rng(5)
    centre = draw.standard_normal(32)
    rows = [(i, (centre + noise * draw.standard_normal(32) if i % 3 == 0 else draw.standard_normal(32)).tolist()) for i in range(1500)]
    want = {q: {i for _, i in best} for q, best in brute_force(rows, 30, 5).items()}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.search(vectors, every=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(want[q] & got.get(q, set())) for q in want) >= 0.9 * 5 * len(want)


def test_copies_and_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [None, 1.0]),
            (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0])] + [(i, [1.0, 0.0]) for i in range(100, 140)]
    vectors = spark.createDataFrame([(a, b, "x", 0.0) for a, b in rows], "vec_id long, embedding array<double>, u string, score double")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nn_descent.search(vectors, k=5).orderBy("query_id", "rank").collect()]
    ids = lambda q: [v for a, _, v, _ in got if a == q]
    assert ids(0) == [1, 2, 11, 50, 100] and ids(50) == [0, 1, 2, 11, 100] and all(s == 1 for _, _, _, s in got)
    assert nn_descent.search(vectors.limit(0)).count() == 0
    one = nn_descent.search(vectors.filter("vec_id = 0"))
    assert one.count() == 0
    stranger = spark.createDataFrame([(999, [1.0, 0.9])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nn_descent.Index(vectors).search(stranger, 1).collect()] == [10]
