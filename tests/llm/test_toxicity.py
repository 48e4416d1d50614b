"""Ordinal regression against a known model, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, toxicity
from test_tokens import SF


def test_ordinal_fit_finds_weights_and_ordered_thresholds():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 2, (4000, 3)).astype(float)
    true, theta = np.array([2.0, -1.0, 0.5]), np.array([0.0, 1.5, 3.0])
    above = 1 / (1 + np.exp(-((x @ true)[:, None] - theta)))
    grades = (draw.random(4000)[:, None] < above).sum(axis=1)
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3, 4, penalty=0.01)
    assert np.allclose(w, true, atol=0.2) and np.allclose(t, theta, atol=0.2) and (np.diff(t) > 0).all()


def test_missing_grades_do_no_harm():
    w, t = toxicity.fit_ordinal(np.array([0, 2]), np.array([0, 0]), np.ones(2), np.array([3, 0, 3, 0]), 1, 5)
    assert np.isfinite(w).all() and np.isfinite(t).all() and (np.diff(t) >= 0).all()


def test_scores_of_a_known_model():
    model = toxicity.Model({"bad": 2.0, "^wors": 1.0}, np.array([1.0, 2.0]), 0.5)
    severity, p, grade, verdict = model.score("Worse WORST, bad bad")
    above = 1 / (1 + np.exp(-(4.0 - np.array([1.0, 2.0]))))
    assert np.isclose(severity, above.sum()) and np.isclose(p, above[0]) and (grade, verdict) == (2, 1)


def test_held_out_accuracy(spark):
    """Fitted without a quarter of the labelled documents, it tells those apart."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.filter(~out))
    rows = toxicity.score(docs, model, ("doc_id",)).join(labels.filter(out), "doc_id").collect()
    toxic = [r for r in rows if r.grade]
    clean = [r for r in rows if not r.grade]
    assert sum(r.toxic for r in toxic) > 0.85 * len(toxic)          # some are labelled toxic for other junk
    assert sum(r.toxic for r in clean) < 0.02 * len(clean)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxic_documents_of_small_tables_are_rejected(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id",)).drop("grade").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.grade]
    clean = [r for r in rows if not r.grade]
    assert len(toxic) > 10 and sum(r.toxic for r in toxic) > 0.9 * len(toxic)
    assert sum(r.toxic for r in clean) < 0.1 * len(clean)


def test_op8_rows(spark):
    rows = queries.op8_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 and r.toxic in (0, 1) for r in rows)


def test_edge_cases(spark):
    own = lambda i: " ".join(chr(97 + (i * k) % 26) + chr(97 + i // 26) for k in (1, 3, 5, 7))     # texts aren't near copies
    texts = [(i, f"{own(i)} awful{'abc'[i // 2 % 3]} {own(i + 300)}" if i % 2 else f"{own(i)} fine {own(i + 300)}") for i in range(200)]
    texts += [(None, None), (300, ""), (300, ""), (301, "12 34 !"), (302, "word " * 50_000 + "awfula awfulb awfulc")]
    docs = spark.createDataFrame([(a, b, 9, 0.5) for a, b in texts], "doc_id long, text string, grade int, toxic double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 1), (None, 1), (2, None), (999, 1)], "doc_id long, grade int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.toxic for r in rows if r.doc_id in (300, 301, 302)} == {300: 0, 301: 0, 302: 1}
    assert all(r.toxic == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 200)
    for some in (labels.limit(0), labels.filter("grade = 0")):
        assert not any(r.toxic for r in toxicity.score(docs, toxicity.fit(docs, some)).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
