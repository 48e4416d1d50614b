"""Links found through the index against all pairs in numpy, and the query against its SQL twin."""

import numpy as np
import pytest

from assayer.llm import multi_index, queries
from oracle_check import compare, connect


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13_matches_sql(spark, sf):
    assert compare(queries.LLM_QUERIES["op13_multi_index"](spark, sf), connect(sf), queries.LLM_ORACLES["op13_multi_index"]) is None


def plain(rows, threshold=0.95):
    """{(vec_id, position)...} as sorted rows; vectors usable and of one length."""
    v = np.array([r[1] for r in rows], float)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        low = np.array([min([root[i], *root[near[i]]]) for i in range(len(rows))])
        if (low == root).all():
            break
        root = low
    least = {r: min(i for i, c in zip([x[0] for x in rows], root) if c == r) for r in set(root)}
    return sorted((int(i), int(n), int(least[c]), bool(i == least[c])) for (i, _), n, c in zip(rows, near.sum(axis=1), root)), int(near.sum())


def result(df, **how):
    return sorted(tuple(r) for r in multi_index.near_vectors(df, **how).collect())


def clusters(seed, n, dims, noise, copies=0):
    """A third of the rows near one another, as many small groups, the rest apart."""
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dims))
    third = n // 3
    base[:third] = base[0] + noise * draw.standard_normal((third, dims)) * np.linspace(0.1, 1, third)[:, None]
    for i in range(third, 2 * third, 3):
        base[i:i + 3] = base[i] + 0.25 * draw.standard_normal((len(base[i:i + 3]), dims)) * np.array([[0], [0.6], [1]])[:len(base[i:i + 3])]
    rows = [(int(i), x.astype(np.float32).tolist()) for i, x in zip(draw.permutation(n) + 5, base)]
    return rows + [(n + 10 + i, rows[i % 4][1]) for i in range(copies)]


def test_links_of_a_large_table(spark):
    """Pairs near the threshold are the hardest; of all of them at least nine in ten, none below the threshold."""
    rows = clusters(1, 6000, 64, 0.22)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    want, links = plain(rows)
    got = result(df)
    assert sum(r[1] for r in got) >= 0.97 * links > 1000
    true = {r[0]: r[1] for r in want}
    assert all(r[1] <= true[r[0]] for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("tile", [4096, 40])
def test_tiles_and_copies(spark, tile):
    """With every cell visited nothing may be lost or counted twice, in tiles or not."""
    rows = clusters(2, 400, 8, 0.2, copies=150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert result(df, visits=10_000, tile=tile) == plain(rows)[0]


def test_cells_come_in_the_order_of_their_distance():
    draw = np.random.default_rng(5)
    books = [draw.standard_normal((7, 3)), draw.standard_normal((7, 3))]
    u = draw.standard_normal((50, 6))
    total = (multi_index.distances(u[:, :3], books[0])[:, :, None] + multi_index.distances(u[:, 3:], books[1])[:, None, :]).reshape(50, 49)
    for visits in (1, 5, 20, 49):
        assert (multi_index.nearest_cells(u, books, visits) == np.argsort(total, axis=1)[:, :visits]).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0, 2.0]), (3, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []),
            (10, [-1.0, 0.0]), (11, [-3.0]), (None, [0.0, -1.0]), (None, [0.0, -2.0]), (12, [1e-310, 1e-310]), (13, [1e300, 1e300])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, node int, cells string")
    got = sorted((tuple(r) for r in multi_index.near_vectors(df, 0.97).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 3, 3, True), (4, 3, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 3, False),
                   (9, 3, 3, False), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (13, 1, 12, False), (None, 1, None, True), (None, 1, None, True)]
    assert multi_index.near_vectors(df.limit(0)).count() == 0
    assert result(df.filter("vec_id = 7")) == [(7, 0, 7, True)]
