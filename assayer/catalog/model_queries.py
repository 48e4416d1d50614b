"""Fusion and forest models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import blocks, scored_long
from ..constants import SOURCE_TECHNIQUES
from ..operators import errors, features, fusion, metrics
from ..operators.models import Forest
from ..plans import evaluation
from ..session import materialize, shared_dir
from .feature_queries import _COND, _PERTURBED
from .metric_queries import rounded
from .registry import BLOCKS, WIDE, metrics_sql, query


def _split(df):
    r = F.pmod("sample_id", F.lit(10))
    return df.withColumn("split", F.when(r < 6, F.lit("train")).when(r < 8, F.lit("val")).otherwise(F.lit("test")))


def _matrix(spark, d):
    return errors.score_matrix(scored_long(spark, d), SOURCE_TECHNIQUES, carry=["label", "generator"])


_PRIOR = ", ".join(f"round(coalesce(t0{i},0.5),6) as \"T0{i}\", cast(t0{i} is not null as double) as \"has_T0{i}\"" for i in range(1, 5))
_MEAN = ", ".join(f"round(coalesce(t0{i},(select avg(t0{i}) from wide)),6) as \"T0{i}\", cast(t0{i} is not null as double) as \"has_T0{i}\"" for i in range(1, 5))


@query("imputed_prior", f"with {WIDE} select sample_id, {_PRIOR} from wide")
def imputed_prior(spark, d):
    m = _matrix(spark, d)
    filled = fusion.imputed(m, SOURCE_TECHNIQUES, fusion.imputation_values(m, SOURCE_TECHNIQUES, "prior"))
    return rounded(filled.drop("label", "generator"), *SOURCE_TECHNIQUES)


@query("imputed_mean", f"with {WIDE} select sample_id, {_MEAN} from wide")
def imputed_mean(spark, d):
    m = _matrix(spark, d)
    filled = fusion.imputed(m, SOURCE_TECHNIQUES, fusion.imputation_values(m, SOURCE_TECHNIQUES, "mean"))
    return rounded(filled.drop("label", "generator"), *SOURCE_TECHNIQUES)


_Z = ", ".join(f"round(({c}-avg({c}) over ())/case when stddev_pop({c}) over ()>1e-12 then stddev_pop({c}) over () else 1 end,6) as \"{n}\""
               for i in range(1, 5) for c, n in ((f"x{i}", f"T0{i}"), (f"m{i}", f"has_T0{i}")))
_Z_IN = ", ".join(f"coalesce(t0{i},0.5) as x{i}, cast(t0{i} is not null as double) as m{i}" for i in range(1, 5))


@query("standardised_scores", f"with {WIDE}, f as (select sample_id, {_Z_IN} from wide) select sample_id, {_Z} from f")
def standardised_scores(spark, d):
    m = _matrix(spark, d)
    filled = fusion.imputed(m, SOURCE_TECHNIQUES, fusion.imputation_values(m, SOURCE_TECHNIQUES, "prior")).drop("label", "generator")
    cols = [c for c in filled.columns if c != "sample_id"]
    return rounded(fusion.standardised(filled, fusion.scaling(filled, cols)), *cols)


@query("fusion_scores")
def fusion_scores(spark, d):
    s = _split(scored_long(spark, d))
    model = evaluation.fit_fusion(s)
    return rounded(evaluation.fused_scores(model, s.filter("split = 'test'")), "score")


@query("fusion_weights")
def fusion_weights(spark, d):
    return rounded(evaluation.fit_fusion(_split(scored_long(spark, d))).weights(spark), "weight", digits=4)


@query("fusion_without_each_source")
def fusion_without_each_source(spark, d):
    """The fitted fusion scored with one source missing at a time."""
    s = _split(scored_long(spark, d))
    model = evaluation.fit_fusion(s)
    test = s.filter("split = 'test'")
    missing = test.withColumn("dropped", F.explode(F.array(*[F.lit(t) for t in SOURCE_TECHNIQUES]))).filter("technique <> dropped")
    fused = evaluation.fused_scores(model, missing, ("dropped", "sample_id"))
    return rounded(metrics.evaluate(fused, ["dropped"]).select("dropped", "n_samples", "auc"), "auc")


@query("fusion_boosted_trees")
def fusion_boosted_trees(spark, d):
    s = _split(scored_long(spark, d))
    val = errors.score_matrix(s.filter("split = 'val'"), SOURCE_TECHNIQUES, carry=["label"])
    model = fusion.Fusion("gradient_boosting").fit(materialize(val, "fusion_matrix"))
    return rounded(evaluation.fused_scores(model, s.filter("split = 'test'")), "score")


@query("fusion_reloaded")
def fusion_reloaded(spark, d):
    s = _split(scored_long(spark, d))
    path = shared_dir(spark, "fusion_model")
    evaluation.fit_fusion(s).save(path)
    return rounded(evaluation.fused_scores(fusion.Fusion.load(path), s.filter("split = 'test'")), "score")


# Parameters of the query: intercept and weights of two given fusions, by source.
_VARIANTS = {"three": (("T01", "T02", "T03"), -0.4, (0.9, 0.7, -0.2)), "four": (("T01", "T02", "T03", "T04"), -0.6, (0.8, 0.5, -0.1, 1.1))}
_MARGIN = {name: " + ".join([str(b), *[f"{w}*coalesce({s.lower()},0.5)" for s, w in zip(sources, ws)]]) for name, (sources, b, ws) in _VARIANTS.items()}


@query("fusion_variant_choice", f"""with {WIDE}, v as (select *, case when t01 is null or t02 is null or t03 is null then null when t04 is null then 'three' else 'four' end as variant from wide)
select sample_id, variant, round(1/(1+exp(-(case variant when 'three' then {_MARGIN['three']} when 'four' then {_MARGIN['four']} end))),6) as score from v""")
def fusion_variant_choice(spark, d):
    """Rows with three and with four sources, each scored by its own variant."""
    registry = {frozenset(sources): (name, fusion.given(sources, b, ws)) for name, (sources, b, ws) in _VARIANTS.items()}
    matrix = errors.score_matrix(scored_long(spark, d), SOURCE_TECHNIQUES)
    return rounded(fusion.score_by_availability(matrix, registry), "score").select("sample_id", "variant", "score")


@query("robustness_run", f"""with {BLOCKS}, cnd as (select condition, kind, level::double as level from {_COND}),
g as (select block, condition, kind, level, k, pixels, md5('42|'||block||'|'||k) as h from blk, cnd, range(0,64) r(k) where kind<>'resize' or k<floor(64*level)),
v as (select block, condition, {_PERTURBED} as x from g),
sc as (select block as sample_id, (block%2)::int as label, condition, 'mean' as technique, avg(x)/255 as score from v group by all
 union all select block, (block%2)::int, condition, 'range', (max(x)-min(x))/255 from v group by all),
{metrics_sql('sc', 'technique, condition')}
select a.technique, a.condition, a.n_samples, round(a.auc,6) auc, round(c.auc,6) clean_auc, round(a.auc-c.auc,6) as change from m a join m c on a.technique=c.technique and c.condition='clean'""")
def robustness_run(spark, d):
    """Every signal under ten conditions, scored by two simple techniques; conditions compare equal samples."""
    s = blocks(spark, d).select(F.col("block").alias("sample_id"), F.pmod("block", F.lit(2)).cast("int").alias("label"), "pixels")
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v) / F.size("pixels") / 255
    scorers = {"mean": lambda x: x.withColumn("score", mean), "range": lambda x: x.withColumn("score", (F.array_max("pixels") - F.array_min("pixels")) / 255)}
    scores = evaluation.robustness_scores(s, scorers)
    return rounded(evaluation.robustness(evaluation.common_samples(scores)), "auc", "clean_auc", "change")


@query("fit_status", "select technique, status from (values ('forest','erro'),('fusion','ok')) v(technique,status)")
def fit_status(spark, d):
    """A failing fit is recorded; the other goes on."""
    s = _split(scored_long(spark, d))
    def bad():
        raise RuntimeError("no features")
    _, status = evaluation.fit_techniques(spark, {"forest": bad, "fusion": lambda: evaluation.fit_fusion(s)})
    return status.select("technique", "status")


def _samples(spark, d):
    b = blocks(spark, d).withColumn("sample", F.col("block"))
    v = features.feature_vectors(b)
    return materialize(v.select(F.col("sample").alias("sample_id"), F.pmod("sample", F.lit(2)).cast("int").alias("label"), "features"), "features")


def _forest(train):
    return Forest(trees=(10, 20), depths=(5,), folds=3).fit(train)


@query("forest_scores")
def forest_scores(spark, d):
    v = _samples(spark, d)
    model = _forest(v.filter("sample_id % 4 <> 3"))
    return rounded(model.score(v.filter("sample_id % 4 = 3")), "score")


@query("forest_importances")
def forest_importances(spark, d):
    model = _forest(_samples(spark, d))
    return rounded(model.importances(features.feature_names(spark)), "weight")


@query("stored_run_status", "select 'T05' as technique, count(*) n, 0::bigint n_not_finite, 0::bigint n_out_of_range, count(*) n_expected, '' as error, 'ok' as status from events where event_id%10>=8")
def stored_run_status(spark, d):
    """Score with the fusion, store, validate; the time per sample is not compared."""
    s = _split(scored_long(spark, d))
    test = errors.score_matrix(s.filter("split = 'test'"), SOURCE_TECHNIQUES, carry=["label"]).withColumn("technique", F.lit("T05"))
    return evaluation.score_and_store(evaluation.fit_fusion(s), test, shared_dir(spark, "run")).drop("ms_per_sample")
