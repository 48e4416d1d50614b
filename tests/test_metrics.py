"""Metrics and curves against hand values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import curves, draws, errors, metrics
from assayer.operators.summaries import exact_median
from assayer.functions.numeric import two_sided_p


def frame(spark, y, p, gens=None, technique="T01"):
    rows = [(i, int(a), float(b), (gens[i] if gens else ("real" if a == 0 else "g")), technique)
            for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "sample_id int, label int, score double, generator string, technique string")


def brute_auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    return float(((pos > neg) + 0.5 * (pos == neg)).mean())


def skewed(n, seed, hot=0.35):
    """Scores of which a third is one value, on both classes."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.where(rng.random(n) < hot, 0.7, np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1))
    return y, p


@pytest.mark.parametrize("n_blocks", [1, 3, 16])
def test_auc_with_a_hot_score_equals_brute_force(spark, n_blocks):
    y, p = skewed(1500, 1)
    row = metrics.evaluate(frame(spark, y, p), ["technique"], n_blocks=n_blocks).first()
    assert row["auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
    hit = p >= 0.5
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (
        (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())


@pytest.mark.parametrize("scores,expected", [([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0), ([0.5] * 4, 0.5)])
def test_perfect_inverted_constant(spark, scores, expected):
    assert metrics.auc(frame(spark, [0, 0, 1, 1], scores), ["technique"]).first()["auc"] == expected


def test_rates_by_hand(spark):
    row = metrics.evaluate(frame(spark, [0, 0, 0, 0, 1, 1, 1, 1], [.9, .8, .1, .2, .9, .8, .7, .1]), ["technique"]).first()
    assert row["fpr"] == 0.5 and row["fnr"] == 0.25


def test_threshold_is_inclusive(spark):
    assert metrics.evaluate(frame(spark, [0, 1], [.4999, .5]), ["technique"]).first()["accuracy"] == 1.0


def test_single_class_has_no_auc(spark):
    row = metrics.evaluate(frame(spark, [1, 1, 1], [.9, .8, .7]), ["technique"]).first()
    assert row["auc"] is None and row["fpr"] is None and row["accuracy"] == 1.0


def test_f1_is_zero_when_undefined(spark):
    row = metrics.evaluate(frame(spark, [0, 0], [.1, .2]), ["technique"]).first()
    assert row["f1"] == 0.0 and row["precision"] is None


def test_generators_share_all_reals(spark):
    y, p = [0] * 4 + [1] * 4, [.1, .1, .2, .2, .9, .95, .05, .05]
    gens = ["real"] * 4 + ["glide", "glide", "flux", "flux"]
    got = {r["generator"]: r for r in metrics.evaluate_by_generator(frame(spark, y, p, gens), ["technique"]).collect()}
    assert got["glide"]["auc"] == 1.0 and got["flux"]["auc"] < 0.5 and got["glide"]["n_samples"] == 6
    assert sorted(got) == ["flux", "glide"]


@pytest.mark.parametrize("n_blocks", [1, 7])
def test_generator_auc_with_one_third_in_one_generator(spark, n_blocks):
    y, p = skewed(900, 2)
    rng = np.random.default_rng(3)
    gens = ["real" if a == 0 else ("hot" if rng.random() < 0.7 else f"g{rng.integers(3)}") for a in y]
    got = {r["generator"]: r["auc"] for r in metrics.evaluate_by_generator(
        frame(spark, y, p, gens), ["technique"], n_blocks=n_blocks).collect()}
    for g in set(gens) - {"real"}:
        keep = np.array([a == 0 or b == g for a, b in zip(y, gens)])
        assert got[g] == pytest.approx(brute_auc(y[keep], p[keep]), abs=1e-12)


def brute_roc(y, p):
    """Points at distinct descending thresholds; inner points with unchanged steps dropped."""
    y, p = np.asarray(y), np.asarray(p)
    cuts = np.unique(p)[::-1]
    tp = np.array([((p >= c) & (y == 1)).sum() for c in cuts])
    fp = np.array([((p >= c) & (y == 0)).sum() for c in cuts])
    keep = [i for i in range(len(cuts)) if i in (0, len(cuts) - 1)
            or fp[i + 1] - 2 * fp[i] + fp[i - 1] or tp[i + 1] - 2 * tp[i] + tp[i - 1]]
    return [(0.0, 0.0)] + [(fp[i] / fp[-1], tp[i] / tp[-1]) for i in keep]


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_roc_points(spark, n_blocks):
    y, p = skewed(300, 5)
    p = np.round(p, 2)
    rows = curves.roc_points(frame(spark, y, p), ["technique"], n_blocks=n_blocks).collect()
    got = sorted((r["fpr"], r["tpr"]) for r in rows)
    assert np.allclose(got, sorted(brute_roc(y, p)))
    assert sum(r["threshold"] is None for r in rows) == 1


def brute_delong(y, a, b):
    out = {}
    y = np.asarray(y)
    for k, s in (("a", np.asarray(a)), ("b", np.asarray(b))):
        c = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
        out[k] = (c.mean(1), c.mean(0), c.mean())
    m, n = (y == 1).sum(), (y == 0).sum()
    v = np.var(out["a"][0] - out["b"][0], ddof=1) / m + np.var(out["a"][1] - out["b"][1], ddof=1) / n
    diff = out["a"][2] - out["b"][2]
    return diff, diff / math.sqrt(v), math.erfc(abs(diff) / math.sqrt(v) / math.sqrt(2))


def test_delong_with_hot_scores(spark):
    y, a = skewed(700, 7)
    _, b = skewed(700, 8)
    both = frame(spark, y, a, technique="A").unionByName(frame(spark, y, b, technique="B"))
    row = curves.delong_pairs(both, [("A", "B")], n_blocks=4).first()
    diff, z, p = brute_delong(y, a, b)
    assert row["difference"] == pytest.approx(diff, abs=1e-12)
    assert row["z"] == pytest.approx(z, abs=1e-9) and row["p_value"] == pytest.approx(p, abs=1e-6)


def test_delong_identical_scores(spark):
    y, a = skewed(200, 9)
    both = frame(spark, y, a, technique="A").unionByName(frame(spark, y, a, technique="B"))
    row = curves.delong_pairs(both, [("A", "B")]).first()
    assert row["difference"] == 0 and row["z"] is None and row["p_value"] is None


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.96, -2.981, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")).alias("p")).collect()
    for z, r in zip(zs, got):
        assert r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


def test_bootstrap_interval_matches_resampling(spark):
    """Both ways agree with plain resampling in numpy up to sampling noise."""
    y, p = skewed(400, 11)
    rng = np.random.default_rng(0)
    real, fake = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    aucs = []
    for _ in range(600):
        s = np.concatenate([rng.choice(real, real.size), rng.choice(fake, fake.size)])
        aucs.append(brute_auc(y[s], p[s]))
    want = np.quantile(aucs, [0.025, 0.975])
    df = frame(spark, y, p)
    for got in (curves.bootstrap_interval(df, ["technique"], n_resamples=1000, n_blocks=5).first(),
                curves.bootstrap_interval_hashed(df, ["technique"], n_resamples=300, n_blocks=3).first()):
        assert abs(got["ci_low"] - want[0]) < 0.015 and abs(got["ci_high"] - want[1]) < 0.015
        assert got["ci_low"] < brute_auc(y, p) < got["ci_high"]


def test_bootstrap_depends_on_the_seed_alone(spark):
    rows = spark.range(50_000).selectExpr("'T' technique", "cast(id % 3 = 0 as int) label", "(hash(id) % 20011 + (id % 3) * 500) / 20011.0 score")
    few, many, moved = (curves.bootstrap_interval(df, ["technique"], n_blocks=n).first() for df, n in ((rows, 2), (rows, 16), (rows.repartition(13, "score"), 7)))
    assert few == many == moved
    assert few != curves.bootstrap_interval(rows, ["technique"], seed=1).first()


def test_every_replicate_draws_the_size_of_each_class(spark):
    y, p = skewed(300, 5)
    p = np.concatenate([np.round(p, 2), [-1e300, -0.0, 0.0, 5e-324, 1e300]])
    y = np.concatenate([y, [0, 1, 0, 1, 1]])
    df = frame(spark, y.tolist(), p.tolist())
    few, many = (sorted(map(tuple, curves.bootstrap_replicates(df, ["technique"], n_resamples=200, n_blocks=n).collect())) for n in (1, 13))
    assert few == many and len(few) == 200
    assert {(r[2], r[3]) for r in few} == {(int(y.sum()), int(len(y) - y.sum()))}


def test_a_score_is_drawn_as_often_as_its_share():
    keys = draws.order_bits(np.array([-2.0, -1.0, 0.0, 0.5, 0.75, 8.0]))
    assert (np.diff(keys.astype(object)) > 0).all()
    counts = np.array([5, 0, 1, 3, 90, 1])
    got = dict(draws.allotted(keys, counts, np.full(20_000, 100), ("s",)))
    assert 1 not in got and (sum(got.values()) == 100).all()
    for i, n in enumerate(counts):
        if n:
            assert abs(got[i].mean() - n) < 0.1 and abs(got[i].var() - n * (1 - n / 100)) < 0.4
    bounds = draws.order_bits(np.array([0.1, 0.2, 0.5, 0.9]))
    x = draws.order_bits(np.sort(np.random.default_rng(0).uniform(-1, 2, 500)))
    leaf = draws.leaf_of(x, bounds)
    assert (np.diff(leaf.astype(object)) >= 0).all()                # blocks are ranges in order
    inside = [len(set(np.searchsorted(bounds, x[leaf == f], side="right").tolist())) for f in np.unique(leaf)]
    assert max(inside) <= 2 and len(inside) > 3


def test_bootstrap_is_reproducible_and_needs_two_classes(spark):
    y, p = skewed(200, 12)
    df = frame(spark, y, p)
    one = curves.bootstrap_interval(df, ["technique"], n_resamples=50, n_blocks=2).first()
    assert one == curves.bootstrap_interval(df, ["technique"], n_resamples=50, n_blocks=2).first()
    assert curves.bootstrap_interval(frame(spark, [1, 1], [.1, .9]), ["technique"], n_resamples=5).count() == 0


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [2.0] * 9 + [8.0], list(range(100))])
def test_median(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    assert exact_median(df, ["k"], "v", n_blocks=4).first()["median_ms"] == np.median(values)


def test_error_reports(spark):
    """Three base techniques and the fusion on six samples, checked by hand."""
    rows = []
    scores = {"T01": [.9, .1, .9, .1, .1, .9], "T02": [.9, .1, .1, .9, .1, .1], "T03": [.1, .9, .1, .1, .9, .9], "T05": [.9, .9, .1, .9, .1, .9]}
    labels = [1, 0, 1, 0, 1, 0]
    for t, s in scores.items():
        rows += [(i, labels[i], "real" if labels[i] == 0 else "g", t, s[i]) for i in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, label int, generator string, technique string, score double")
    names, base = ["T01", "T02", "T03", "T05"], ["T01", "T02", "T03"]
    h = errors.hits(errors.score_matrix(df, names, carry=["label", "generator"]), names, base).cache()
    assert {r["n_hits"]: r["n"] for r in errors.hit_distribution(h).collect()} == {1: 3, 2: 3}
    rescue = {r["technique"]: (r["errors"], r["rescued"]) for r in errors.fusion_rescue(h, base).collect()}
    assert rescue == {"T01": (2, 0), "T02": (3, 0), "T03": (4, 1)}
    assert errors.fusion_spoil(h, base).first()["spoiled"] == 2
    assert errors.disagreement(h, base).filter("pair = 'T01_T02'").first()["rate"] == pytest.approx(3 / 6)


def test_empty_input_gives_no_rows(spark):
    df = frame(spark, [0, 1], [.1, .9]).filter("label = 7")
    assert metrics.evaluate(df, ["technique"]).count() == 0
    assert curves.roc_points(df, ["technique"]).count() == 0


def test_missing_scores_are_left_out(spark):
    df = frame(spark, [0, 1, 1], [.1, .9, .2]).withColumn("score", F.when(F.col("sample_id") != 2, F.col("score")))
    row = metrics.evaluate(df, ["technique"]).first()
    assert row["n_samples"] == 2 and row["auc"] == 1.0


@pytest.mark.parametrize("n_blocks", [1, 2, 8, 40])
def test_placements_of_rows(spark, n_blocks):
    y, p = skewed(600, 21)
    df = frame(spark, y, p)
    got = {r["sample_id"]: r["placement"] for r in curves.placements(df, ["technique"], n_blocks=n_blocks).collect()}
    c = (p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :])
    want = dict(zip(np.flatnonzero(y == 1), c.mean(1))) | dict(zip(np.flatnonzero(y == 0), c.mean(0)))
    assert len(got) == 600 and all(got[i] == pytest.approx(v, abs=1e-12) for i, v in want.items())


def test_a_frequent_score_is_not_shuffled(spark):
    from assayer.operators.ranking import row_blocks
    y, p = skewed(3000, 22)
    block, single = row_blocks(frame(spark, y, p), "score", 16)
    tagged = frame(spark, y, p).select("score", block.alias("b"), single.alias("hot")).cache()
    assert tagged.filter("hot and score <> 0.7").isEmpty() and tagged.filter("not hot and score = 0.7").isEmpty()
    assert max(r["count"] for r in tagged.filter("not hot").groupBy("b").count().collect()) < 3000 / 16 * 2
    order = [r["b"] for r in tagged.orderBy("score").collect()]
    assert order == sorted(order)


def test_md5_draws_of_many_at_once():
    import hashlib
    for prefix, first, end in ((b"42|7|1|", 0, 1_200), (b"s" * 49 + b"|", 99_990, 100_010), (b"", 5, 6), (b"42|20|0|", 999_990, 1_000_020)):
        want = [int(hashlib.md5(prefix + b"%d" % k).hexdigest()[:15], 16) for k in range(first, end)]
        assert draws.md5_numbers(prefix, first, end, at_once=500).tolist() == want


def test_hashed_bootstrap_by_its_definition(spark):
    """Two groups of equal and one of other class sizes, ranks in two blocks, replicates in two rounds."""
    import hashlib
    n, rounds = 70_000, 34
    rows = spark.range(n).selectExpr("id sample_id", "cast(id % 9 = 0 as int) label", "explode(array('A', 'B', 'C')) technique").filter("technique <> 'C' or sample_id % 3 < 2").selectExpr(
        "*", "pmod(hash(sample_id, technique), 50) / 50D + label * 0.1D score")
    got = {r.technique: r for r in curves.bootstrap_interval_hashed(rows, ["technique"], n_resamples=rounds, n_blocks=3).collect()}
    aucs = {}
    cells = rows.toPandas()
    cells["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in cells.sample_id]
    cells = cells.sort_values(["h", "sample_id"])
    for b in range(1, rounds + 1):
        h = {y: draws.md5_numbers(f"42|{b}|{y}|".encode(), 0, n) for y in (0, 1)}
        for name, part in cells.groupby("technique"):
            s = {y: part[part.label == y].score.to_numpy() for y in (0, 1)}
            real, fake = (np.sort(s[y][(h[y][:len(s[y])] % np.uint64(len(s[y]))).astype(int)]) for y in (0, 1))
            below = (np.searchsorted(real, fake, "left") + np.searchsorted(real, fake, "right")).sum() / 2
            aucs.setdefault(name, []).append(below / (len(real) * len(fake)))
    assert set(got) == {"A", "B", "C"}
    for name, r in got.items():
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(aucs[name], [0.025, 0.975])), abs=1e-12)


def test_delong_groups_no_samples_again(spark, monkeypatch):
    """Many small tasks, hot scores and samples that one side lacks: equal to brute force, and after the matrix nothing is grouped by sample."""
    monkeypatch.setattr(curves, "TASK_ROWS", 50, raising=False)
    y, a = skewed(900, 17)
    _, b = skewed(900, 18)
    both = frame(spark, y, a, technique="A").unionByName(frame(spark, y, b, technique="B").filter("sample_id % 7 <> 3"))
    tests = curves.delong_pairs(both, [("A", "B"), ("B", "A")])
    plan = tests._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "_id" in line]
    assert "RepartitionByExpression" in plan
    kept = np.arange(900) % 7 != 3
    diff, z, _ = brute_delong(np.asarray(y)[kept], np.asarray(a)[kept], np.asarray(b)[kept])
    got = {r.technique_a: r for r in tests.collect()}
    assert got["A"].difference == pytest.approx(diff, abs=1e-12) and got["A"].z == pytest.approx(z, abs=1e-9)
    assert got["B"].difference == pytest.approx(-diff, abs=1e-12) and got["B"].z == pytest.approx(-z, abs=1e-9)


def test_bootstrap_draws_are_as_before_and_cheap():
    """The draws of a fixed case, taken before nodes shared a generator; a generator that is set to a key goes on like a new one."""
    import hashlib
    digest, keys = hashlib.md5(), draws.order_bits(np.array([0.1, 0.2, 0.3, 5.0]))
    for total in (1, 5, 100, 10**6, 10**9):
        for counts in ([1, 1, 1, 1], [1000, 1, 1, 10], [0, 5, 0, 7]):
            for i, k in draws.allotted(keys, np.array(counts), np.full(500, total), ("x", total)):
                digest.update(b"%d" % i + k.astype(np.int64).tobytes())
    assert digest.hexdigest() == "b9107740857096f42b6c377961d7df27"
    seeded = draws._Generators()
    for key in (("a", 1), ("b", 2), ("a", 1)):
        fresh = np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(repr(key).encode()).digest(), "big")))
        assert (seeded(key).binomial(np.arange(300), 0.3) == fresh.binomial(np.arange(300), 0.3)).all()


def test_drawing_tasks_are_not_joined(spark):
    drawn = curves.bootstrap_replicates(spark.range(100).selectExpr("'T' technique", "cast(id % 2 as int) label", "id / 100D score"), ["technique"], n_resamples=3)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_delong_tasks_hold_even_shares(spark, monkeypatch):
    """More pairs than techniques, whose scores lie apart so that a block of all rows is a block of one pair: tasks still hold about TASK_ROWS rows."""
    monkeypatch.setattr(curves, "TASK_ROWS", 500)
    names = ["A", "B", "C", "D"]
    y, _ = skewed(2000, 19)
    scores = [skewed(2000, 20 + i)[1] + 2 * i for i in range(4)]
    table = frame(spark, y, scores[0], technique="A")
    for name, s in zip(names[1:], scores[1:]):
        table = table.unionByName(frame(spark, y, s, technique=name))
    dealt, plain = [], type(table).repartition
    monkeypatch.setattr(type(table), "repartition", lambda self, *a: dealt.append(plain(self, *a)) or dealt[-1])
    got = {(r.technique_a, r.technique_b): r for r in curves.delong_pairs(table, [(a, b) for a in names for b in names if a != b]).collect()}
    assert len(got) == 12 and len(dealt) == 3
    assert max(part.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for part in dealt) < 3 * curves.TASK_ROWS
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                diff, z, _ = brute_delong(np.asarray(y), scores[i], scores[j])
                assert got[a, b].difference == pytest.approx(diff, abs=1e-12) and got[a, b].z == pytest.approx(z, abs=1e-9)


@pytest.mark.parametrize("n_blocks", [1, 2, 7, 40])
def test_compiled_block_search(spark, n_blocks):
    """The same blocks as the expression gives, also of nulls, NaN and values beyond the points, and no lambda in the plan."""
    from assayer.operators.ranking import block_of, row_points, with_row_block
    y, p = skewed(3000, 23)
    rows = frame(spark, y, p)
    points, single = row_points(rows, "score", n_blocks)
    block = block_of(F.col("score"), F.array(*[F.lit(p) for p in points]), len(points)) * 2 + single.cast("int")
    odd = spark.createDataFrame([(None,), (float("nan"),), (-9.0,), (9.0,), (float("inf"),), (-0.0,)], "score double")
    tagged = with_row_block(rows.select("score").unionByName(odd), "score", points, single, "b")
    assert tagged.filter(~block.eqNullSafe(F.col("b"))).isEmpty()
    assert tagged.select("b").distinct().count() >= min(n_blocks, 2)
    assert "lambda" not in tagged._jdf.queryExecution().optimizedPlan().toString()


def test_delong_tasks_sort_nothing_they_write(spark, monkeypatch):
    """However many rows there are, the shuffles stay within the reducers up to which Spark holds no map output in memory."""
    monkeypatch.setattr(curves, "TASK_ROWS", 1)
    y, a = skewed(300, 24)
    both = frame(spark, y, a, technique="A").unionByName(frame(spark, y, skewed(300, 25)[1], technique="B"))
    dealt, plain = [], type(both).repartition
    monkeypatch.setattr(type(both), "repartition", lambda self, n, *keys: dealt.append(n) or plain(self, n, *keys))
    curves.delong_pairs(both, [("A", "B")])
    assert dealt == [200, 200, 200]
