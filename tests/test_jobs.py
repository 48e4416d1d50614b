"""Whole jobs: runs that go on after a stop, the score cache, robustness, choice of a fusion by row."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import features, fusion
from assayer.operators.models import Forest
from assayer.plans import evaluation


def test_a_stopped_multi_seed_run_goes_on(spark, tmp_path):
    """Killed while a run writes, and between its scores and its record: nothing is lost or doubled."""
    calls, stop = [], {("T01", 123): "before", ("T02", 42): "after"}

    def run(technique, seed):
        calls.append((technique, seed))
        rows = spark.range(20).select(F.col("id").alias("sample_id"), F.pmod("id", F.lit(2)).cast("int").alias("label"), (F.col("id") * seed % 7 / 7).alias("score"))
        how = stop.pop((technique, seed), None)
        if how == "before":
            raise KeyboardInterrupt
        if how == "after":      # scores are written, the record isn't
            rows.withColumn("score", F.lit(9.0)).withColumns({"technique": F.lit(technique), "seed": F.lit(seed)}).write.parquet(f"{path}/scores/{technique}-{seed}")
            raise KeyboardInterrupt
        return rows

    path = str(tmp_path / "runs")
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            evaluation.run_multi_seed(spark, run, path, ["T01", "T02"], [42, 123])
    scores = evaluation.run_multi_seed(spark, run, path, ["T01", "T02"], [42, 123])
    assert scores.count() == 80 and scores.agg(F.max("score")).first()[0] < 1
    assert calls == [("T01", 42), ("T01", 123), ("T01", 123), ("T02", 42), ("T02", 42), ("T02", 123)]
    assert evaluation.run_multi_seed(spark, run, path, ["T01"], [42]).count() == 20 and len(calls) == 6
    runs, summary = evaluation.multi_seed(scores)
    assert runs.count() == 4 and {r.n_runs if "n_runs" in r else 2 for r in summary.collect()} == {2}


def test_the_score_cache_hits_by_version(spark, tmp_path):
    key = lambda ids, version: spark.createDataFrame([("m", "T01", version, "clean", i, i / 10) for i in ids], "manifest_id string, technique string, model_version string, condition string, sample_id long, score double")
    cache = evaluation.ScoreCache(spark, str(tmp_path / "cache"), buckets=4)
    assert cache.merge(key(range(5), "v1")) == 5
    assert cache.merge(key([3, 4, 5, 5], "v1").withColumn("score", F.lit(0.0))) == 1
    again = evaluation.ScoreCache(spark, str(tmp_path / "cache"), buckets=4)
    hits, misses = again.lookup(key(range(8), "v1").drop("score"))
    assert {r.sample_id: r.score for r in hits.collect()} == {0: 0.0, 1: 0.1, 2: 0.2, 3: 0.3, 4: 0.4, 5: 0.0}
    assert sorted(r.sample_id for r in misses.collect()) == [6, 7]
    hits, misses = again.lookup(key(range(8), "v2").drop("score"))
    assert hits.count() == 0 and misses.count() == 8


def test_robustness_of_a_forest_on_equal_samples(spark):
    blocks = spark.range(40).select(F.col("id").alias("sample_id"), F.pmod("id", F.lit(2)).cast("int").alias("label"), F.transform(
        F.sequence(F.lit(0), F.lit(255)), lambda k: F.pmod(F.hash("id", k), F.when(F.col("id") % 2 == 0, 256).otherwise(32)).cast("double")).alias("pixels"))
    clean = features.perturb_signal(blocks).filter("condition = 'clean'")
    forest = Forest(trees=(10,), depths=(5,), folds=2).fit(evaluation.signal_features(clean).select("sample_id", "label", "features"))
    scores = evaluation.robustness_scores(blocks, {"T03": lambda x: forest.score(evaluation.signal_features(x))}, limit=30)
    short = scores.filter("not (condition = 'resize_50' and sample_id = (select min(sample_id) from {s}))".replace("(select min(sample_id) from {s})", str(scores.agg(F.min("sample_id")).first()[0])))
    common = evaluation.common_samples(short)
    table = {r.condition: r for r in evaluation.robustness(common).collect()}
    assert len(table) == 10 and {r.n_samples for r in table.values()} == {29}
    assert table["clean"].auc > 0.9 and table["clean"].change == 0
    assert all(r.change == r.auc - table["clean"].auc for r in table.values())


def test_rows_are_scored_by_the_variant_for_their_sources(spark):
    rows = [(i, i % 2, (i * 7 % 10) / 10, (i * 3 % 10) / 10 if i % 3 else None, (i * 9 % 11) / 11 if i % 4 else float("nan")) for i in range(60)]
    matrix = spark.createDataFrame(rows, "sample_id long, label int, T01 double, T02 double, T03 double")
    one, two = (fusion.Fusion(sources=s).fit(matrix) for s in (("T01", "T02"), ("T01", "T02", "T03")))
    registry = {frozenset(one.sources): ("one", one), frozenset(two.sources): ("two", two)}
    got = {r.sample_id: (r.variant, r.score) for r in fusion.score_by_availability(matrix, registry, ("T01", "T02", "T03")).collect()}
    by = {name: {r.sample_id: r.score for r in m.score(matrix).collect()} for name, m in registry.values()}
    for i, _, _, b, c in rows:
        want = None if b is None else "one" if c != c else "two"
        assert got[i][0] == want and got[i][1] == (by[want][i] if want else None)
