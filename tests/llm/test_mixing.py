"""Mixing plan against its SQL twin, weights against plain Python, drawn documents against the plan."""

import collections
import math

import pytest

from assayer.llm import mixing, queries
from oracle_check import compare, connect


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op2_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(queries.LLM_QUERIES["op2_mixing"](spark, sf), connect(sf), queries.LLM_ORACLES["op2_mixing"]) is None


def documents(spark, sizes, repeats=1):
    rows = [(i, "w " * n, s, "x", "y") for i, (s, n) in enumerate(sizes)] * repeats
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string, epoch string")


def plain_exponent(totals, entropy, most_epochs, budget):
    shares = [t / sum(totals) for t in totals]

    def weights(t):
        p = [s ** t for s in shares]
        return [x / sum(p) for x in p]

    grid = [k / 20000 for k in range(20001)]
    meets = [t for t in grid if -sum(w * math.log(w) for w in weights(t)) >= entropy * math.log(len(totals))]
    rare = [t for t in grid if max(w * budget / s for w, s in zip(weights(t), totals)) <= most_epochs]
    return weights(max(max(meets, default=0.0), min(rare, default=1.0)))


@pytest.mark.parametrize("entropy,most", [(0.9, 100.0), (1.0, 2.0), (0.5, 1.5)])
def test_weights_and_budgets(spark, entropy, most):
    sizes = [("a", 7)] * 900 + [("b", 9)] * 100 + [("c", 5)] * 40
    docs = documents(spark, sizes)
    totals = {s: sum(n for t, n in sizes if t == s) for s in "abc"}
    rows = mixing.plan(docs, entropy, most).collect()
    want = dict(zip("abc", plain_exponent(list(totals.values()), entropy, most, sum(totals.values()))))
    drawn = collections.Counter()
    for r in rows:
        drawn[r.source] += r.tokens
        assert math.isclose(r.weight, want[r.source], abs_tol=2e-4)
    for s in "abc":
        assert want[s] * sum(totals.values()) - 12 <= drawn[s] <= want[s] * sum(totals.values()) + 3
    # Each pass is a gapless order of its source, and whole but for the last.
    for s in "abc":
        for epoch in {r.epoch for r in rows if r.source == s}:
            at = 0
            for r in sorted((r for r in rows if (r.source, r.epoch) == (s, epoch)), key=lambda r: r.start):
                assert r.start == at
                at += r.tokens
    out = mixing.mixed(docs, entropy, most)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in rows)


def test_hot_source_is_cut_into_blocks(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('w ', 3) text", "if(id % 3 = 0, 'hot', 'cold' || id % 2) source")
    plan = mixing.plan(docs, 0.999)
    assert plan.groupBy("source", "epoch", "start").count().filter("count > 1").count() == 0
    drawn = collections.Counter(r.source for r in plan.collect())
    assert abs(drawn["hot"] - drawn["cold0"]) < 0.2 * drawn["hot"]


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", "b"), (4, "word " * 20_000, "b"), (5, " ", "only blank")]
    docs = spark.createDataFrame([(a, b, c, 0, 0) for a, b, c in rows], "doc_id long, text string, source string, weight int, total int")
    out = mixing.mixed(docs, entropy=0.2)
    assert out.columns == docs.columns
    assert {1, 5} <= {r.doc_id for r in out.collect()}
    assert collections.Counter(r.doc_id for r in mixing.plan(docs, 0.2).collect()) == collections.Counter(r.doc_id for r in out.collect())
    assert mixing.mixed(docs.limit(0)).count() == mixing.plan(docs.limit(0)).count() == 0


def test_only_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (mixing.plan(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
