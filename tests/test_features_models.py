"""Features, fusion and forest against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.constants import SOURCE_TECHNIQUES
from assayer.functions.benford import first_digit, renyi, tsallis
from assayer.operators import errors, features, fusion
from assayer.operators.models import Forest
from assayer.plans import evaluation


def test_first_digit(spark):
    cases = [(1.0, 10, 1), (23.0, 10, 2), (-456.0, 10, 4), (.0071, 10, 7), (9999.0, 10, 9), (25.0, 20, 1), (19.0, 20, 19), (0.0, 10, None)]
    df = spark.createDataFrame(cases, "v double, b int, d int")
    assert [r["x"] for r in df.select(first_digit(F.col("v"), F.col("b")).alias("x")).collect()] == [c[2] for c in cases]


def test_benford_law(spark):
    law = features.benford_law(spark)
    assert law.filter("base = 10 and digit = 1").first()["share"] == pytest.approx(0.30103, abs=1e-5)
    assert law.filter("base = 10 and digit = 9").first()["share"] == pytest.approx(0.04576, abs=1e-5)
    assert all(r["s"] == pytest.approx(1.0) for r in law.groupBy("base").agg(F.sum("share").alias("s")).collect())
    with pytest.raises(ValueError):
        features.benford_law(spark, [2])
    for bad in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            renyi(bad)
        with pytest.raises(ValueError):
            tsallis(bad)


def plain_divergences(values, base):
    v = np.abs(np.asarray(values, float))
    v = v[v != 0]
    d = np.arange(1, base)
    q = np.log(1 + 1 / d) / np.log(base)
    if v.size:
        digit = np.clip(np.floor(v / base ** np.floor(np.log(v) / np.log(base))), 1, base - 1).astype(int)
        p = np.bincount(digit, minlength=base)[1:base] / v.size
    else:
        p = np.full(base - 1, 1 / (base - 1))
    p, q = np.clip(p, 1e-12, None), np.clip(q, 1e-12, None)
    m = (p + q) / 2
    s = np.sqrt(p * q).sum()
    return (0.5 * ((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()), -2 * math.log(max(s, 1e-12)), -2 * (s - 1))


@pytest.mark.parametrize("counted", [True, False])
def test_divergences_match_the_full_sum(spark, counted):
    rng = np.random.default_rng(0)
    groups = {"a": list(rng.integers(-300, 300, 500)), "zeros": [0] * 10, "one": [7]}
    df = spark.createDataFrame([(k, int(v)) for k, vs in groups.items() for v in vs], "k string, v int")
    rows = df.groupBy("k", "v").count() if counted else df
    for r in features.benford_divergences(rows, ["k"], "v", count="count" if counted else None).collect():
        want = plain_divergences(groups[r["k"]], r["base"])
        assert (r["jensen_shannon"], r["renyi"], r["tsallis"]) == pytest.approx(want, abs=1e-9)


def test_uniform_digits_without_values(spark):
    df = spark.createDataFrame([("a", 0)] * 5, "k string, v int")
    assert {round(r["share"], 9) for r in features.digit_distribution(df, ["k"], "v", [10]).collect()} == {round(1 / 9, 9)}


def test_block_dct(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (4, 64)).astype(float)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(px)], "block int, pixels array<double>")
    got = {r["block"]: r["coef"] for r in features.block_dct(df).collect()}
    k = np.arange(8)
    c = np.sqrt(2 / 8) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 16)
    c[0] = np.sqrt(1 / 8)
    for i in range(4):
        assert np.allclose(got[i], (c @ (px[i].reshape(8, 8) - 128) @ c.T).ravel(), atol=1e-8)
    flat = spark.createDataFrame([(0, [128.0] * 64)], "block int, pixels array<double>")
    assert set(features.quantised_dct(flat, 90).first()["quantised"]) == {0}


def test_planes_drop_ragged_borders(spark):
    df = spark.createDataFrame([("a", list(map(float, range(17 * 10))))], "sample string, pixels array<double>")
    got = features.split_planes(df, height=10, width=17).orderBy("block_no").collect()
    assert len(got) == 2 and got[1]["pixels"][:2] == [8.0, 9.0] and got[0]["pixels"][8] == 17.0
    with pytest.raises(ValueError):
        features.split_planes(df, height=7, width=17)


def test_feature_vector_is_complete_and_ordered(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("s", rng.integers(0, 256, 64).astype(float).tolist()) for _ in range(30)], "sample string, pixels array<double>")
    v = features.feature_vectors(df).first()["features"]
    assert len(v) == 540 and np.isfinite(v).all()
    names = [r["name"] for r in features.feature_names(spark).orderBy("position").collect()]
    assert len(set(names)) == 540 and names[0] == "qf80_ac1_b10_jensen_shannon" and names[3] == "qf80_ac1_b20_jensen_shannon"
    row = features.benford_features(df).filter("quality = 85 and ac = 2 and base = 40").first()
    assert v[names.index("qf85_ac2_b40_tsallis")] == row["tsallis"]


def test_cooccurrence(spark):
    flat = spark.createDataFrame([("s", [77.0] * 256)], "sample string, pixels array<double>")
    pairs = features.cooccurrence(features.plane_pairs(flat, ["sample"], "pixels", 16, 16), ["sample"]).collect()
    assert len(pairs) == 1 and (pairs[0]["i"], pairs[0]["j"], pairs[0]["share"]) == (77, 77, 1.0)
    ramp = spark.createDataFrame([("s", y, x, x) for y in range(16) for x in range(16)], "sample string, y int, x int, value int")
    got = features.pixel_pairs(ramp, ["sample"]).collect()
    assert {(r["i"], r["j"]) for r in got} == {(i, i + 1) for i in range(15)}
    down = {(r["i"], r["j"]): r["n"] for r in features.pixel_pairs(ramp, ["sample"], dy=1, dx=-1).collect()}
    assert down == {(i, i - 1): 15 for i in range(1, 16)}
    with pytest.raises(ValueError):
        features.plane_pairs(flat, ["sample"], "pixels", 16, 16, dy=16)


def test_class_masks(spark):
    rows = [("s", 0, 0, p, 0.51 if p < 3 else 0.49) for p in range(8)] + [("s", 1, 0, p, 1.0 if p == 5 else 0.0) for p in range(8)]
    m = spark.createDataFrame(rows, "sample string, instance int, klass int, pixel int, value double")
    got = features.class_masks(m, 8).collect()
    assert sorted(r["pixel"] for r in got if r["level"] == 255) == [0, 1, 2, 5]
    assert {r["level"] for r in got if r["klass"] == 1} == {0} and len(got) == 16


def test_perturbations(spark):
    df = spark.createDataFrame([("a", [float(v) for v in range(64)]), ("b", [200.0] * 64)], "sample_id string, pixels array<double>")
    one = features.perturb_signal(df).collect()
    assert {r["condition"] for r in one} == {"clean", "jpeg_q50", "jpeg_q70", "jpeg_q85", "noise_sigma1", "noise_sigma3", "noise_sigma5", "resize_50", "resize_70", "resize_85"}
    assert len({r["output_name"] for r in one}) == 20
    by = {(r["sample_id"], r["condition"]): r["pixels"] for r in one}
    assert len(by[("a", "resize_50")]) == 32 and by[("a", "clean")] == [float(v) for v in range(64)]
    assert by == {(r["sample_id"], r["condition"]): r["pixels"] for r in features.perturb_signal(df).collect()}
    assert np.std(by[("b", "noise_sigma5")]) == pytest.approx(5, abs=1.5)


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(42)
    y = np.array([0] * 60 + [1] * 60)
    cols = {"T01": np.where(y, rng.normal(.75, .12, 120), rng.normal(.25, .12, 120)), "T02": np.where(y, rng.normal(.8, .1, 120), rng.normal(.2, .1, 120)),
            "T03": np.where(y, rng.normal(.58, .2, 120), rng.normal(.42, .2, 120)), "T04": rng.uniform(0, 1, 120)}
    rows = [(i, int(y[i]), "g" if y[i] else "real", t, float(np.clip(c[i], 0, 1)), "val") for t, c in cols.items() for i in range(120) if not (t == "T04" and i % 5 == 0)]
    return spark.createDataFrame(rows, "sample_id int, label int, generator string, technique string, score double, split string").cache()


def test_fusion_equals_the_penalised_optimum(spark, scores):
    model = evaluation.fit_fusion(scores)
    m = errors.score_matrix(scores, SOURCE_TECHNIQUES, carry=["label"]).toPandas()
    x = m[list(SOURCE_TECHNIQUES)].to_numpy(float)
    full = np.hstack([np.where(np.isnan(x), 0.5, x), ~np.isnan(x)])
    sd = full.std(0)
    z = (full - full.mean(0)) / np.where(sd > 0, sd, 1)
    a, w = np.hstack([z, np.ones((len(z), 1))]), np.zeros(9)
    ridge = np.diag([1.0] * 8 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - m["label"]) + ridge @ w)
    got = {r["technique"]: r["weight"] for r in model.weights(spark).collect()}
    assert np.allclose([got[t] for t in SOURCE_TECHNIQUES], w[:4], atol=1e-4)
    assert got["T02"] > got["T04"]


def test_fusion_survives_each_missing_source(spark, scores, tmp_path):
    model = evaluation.fit_fusion(scores, strategy="mean")
    for gone in SOURCE_TECHNIQUES:
        m = errors.score_matrix(scores.filter(F.col("technique") != gone), [t for t in SOURCE_TECHNIQUES if t != gone], carry=["label"])
        got = model.score(m).select("score").collect()
        assert len(got) == 120 and all(0 <= r["score"] <= 1 for r in got)
    model.save(str(tmp_path / "f"))
    m = errors.score_matrix(scores, SOURCE_TECHNIQUES, carry=["label"])
    a = model.score(m).orderBy("sample_id").collect()
    assert a == fusion.Fusion.load(str(tmp_path / "f")).score(m).orderBy("sample_id").collect()
    with pytest.raises(FileNotFoundError):
        fusion.Fusion.load(str(tmp_path / "none"))
    with pytest.raises(fusion.NotFitted):
        fusion.Fusion().score(m)


def test_fusion_refuses_training_scores(scores):
    with pytest.raises(ValueError):
        evaluation.fit_fusion(scores, "train")
    with pytest.raises(ValueError):
        evaluation.fit_fusion(scores, "fusion")


def test_variant_choice():
    reg = {frozenset(("T01", "T02", "T03")): "three", frozenset(SOURCE_TECHNIQUES): "four"}
    assert fusion.pick_variant(reg, SOURCE_TECHNIQUES) == "four"
    assert fusion.pick_variant(reg, ("T01", "T02", "T03")) == "three" and fusion.pick_variant(reg, ("T01",)) is None


def test_forest(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, (rng.normal(0, 1, 6) + (i % 2) * np.array([2, 0, 0, 0, 0, 0])).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id int, label int, features array<double>")
    with pytest.raises(RuntimeError):
        Forest().score(df)
    model = Forest(trees=(5, 10), depths=(3, None), folds=3, balanced=True).fit(df)
    assert model.best["n_estimators"] in (5, 10) and model.best["cv_auc"] > 0.7
    names = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "position int, name string")
    top = model.importances(names).orderBy(F.desc("weight")).first()
    assert top["name"] == "f0"
    model.save(str(tmp_path / "rf"))
    a = [r["score"] for r in model.score(df).orderBy("sample_id").collect()]
    assert a == [r["score"] for r in Forest.load(str(tmp_path / "rf")).score(df).orderBy("sample_id").collect()]


@pytest.mark.parametrize("name,options", [("random_forest", {"numTrees": 5, "maxDepth": 4}), ("gradient_boosting", {"maxIter": 3})])
def test_tree_fusions(spark, scores, tmp_path, name, options):
    m = errors.score_matrix(scores, SOURCE_TECHNIQUES, carry=["label"])
    model = fusion.Fusion(name, options=options).fit(m)
    w = {r["technique"]: r["weight"] for r in model.weights(spark).collect()}
    assert set(w) == set(SOURCE_TECHNIQUES) and w["T02"] >= w["T04"]
    model.save(str(tmp_path / "m"))
    assert fusion.Fusion.load(str(tmp_path / "m")).score(m).filter("score between 0 and 1").count() == 120
    with pytest.raises(ValueError):
        fusion.Fusion("none").fit(m)
    with pytest.raises(ValueError):
        fusion.Fusion(strategy="none").fit(m)
