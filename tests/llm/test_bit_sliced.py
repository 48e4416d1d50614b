"""Bit-sliced arithmetic and top-k against integer products and the SQL twin."""

import numpy as np
import pytest

from assayer.llm import bit_sliced, queries
from oracle_check import compare, connect


def test_op6_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.LLM_QUERIES["op6_bit_sliced"](spark, sf), connect(sf), queries.LLM_ORACLES["op6_bit_sliced"]) is None


def test_products_and_selection_are_exact():
    draw = np.random.default_rng(0)
    for n, dims, size in ((1, 1, 1), (63, 3, 5), (300, 17, 900), (130, 64, 40)):
        values = draw.integers(-size, size + 1, (n, dims))
        maps, low = bit_sliced.slices(values)
        ids = np.sort(draw.choice(10 * n, n, replace=False))
        for query in (*draw.integers(-size, size + 1, (4, dims)), np.zeros(dims, np.int64)):
            for k in (1, 7, n + 3):
                own = int(ids[n // 2])
                got = list(zip(*bit_sliced.search_block(maps, low, ids, own, query, k)))
                want = sorted(((int(s), int(i)) for s, i in zip(values @ query, ids) if i != own), key=lambda x: (-x[0], x[1]))[:k]
                assert sorted(((int(s), int(i)) for i, s in got), key=lambda x: (-x[0], x[1])) == want


def test_blocks_agree_with_one_block(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.integers(-3, 4, 5) / 1024).tolist()) for i in range(400)]     # many ties
    numbers = bit_sliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = numbers.filter("vec_id % 10 = 0")
    few, many = (sorted(map(tuple, bit_sliced.top_k(bit_sliced.build_index(numbers, n), asked, 9).collect())) for n in (1000, 37))
    assert few == many and len(few) == 360


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, nan]), (2, [inf, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]),
            (8, [0.0, 0.0]), (100, [-1.0, 3.0, 5.0])]
    vectors = spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "vec_id long, embedding array<double>, v string, score double")
    got = [tuple(r) for r in bit_sliced.search(vectors).orderBy("query_id", "rank").collect()]
    m = 1 << 20
    assert got == [(0, 1, 7, 5 * m), (0, 2, 8, 5 * m), (0, 3, 100, 5 * m), (0, 4, 6, m), (100, 1, 0, 5 * m), (100, 2, 7, 5 * m), (100, 3, 8, 5 * m), (100, 4, 6, -m)]
    assert bit_sliced.search(vectors.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        bit_sliced.search(spark.createDataFrame([(0, [1e12])], "vec_id long, embedding array<double>")).collect()
