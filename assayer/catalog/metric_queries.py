"""Metrics, curves, significance, error analysis, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..bindings import scored_all, scored_big, scored_long, scored_wide, table
from ..constants import TECHNIQUE_ORDER
from ..operators import curves, errors, filters, metrics, summaries
from ..plans import evaluation
from ..session import shared_dir
from ..sources import sinks
from .registry import ALL, BIG, LONG, M_COLS, ORACLES, WIDE, metrics_sql, query

BASE = ("T01", "T02", "T03", "T04")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("confusion_metrics", f"with {LONG}, {metrics_sql('long', 'technique')} select technique, "
       f"{M_COLS.replace('round(auc,6) auc, ', '')} from m")
def confusion_metrics(spark, d):
    return metrics.report(metrics.classification_metrics(scored_long(spark, d), ["technique"]), ["technique"])


@query("technique_metrics", f"with {ALL}, {metrics_sql('allt', 'technique')} select technique, "
       f"list_position(['T01','T02','T03','T04','T05'], technique) as ordinal, {M_COLS} from m order by ordinal")
def technique_metrics(spark, d):
    m = metrics.report(metrics.evaluate(scored_all(spark, d), ["technique"]), ["technique"])
    return m.withColumn("ordinal", filters.technique_order(F.col("technique"), TECHNIQUE_ORDER)).orderBy("ordinal")


_BY_GEN = """, gens as (select distinct technique t, generator g from {src} where label=1),
pairs as (select g.t as technique, g.g as generator, s.label, s.score from gens g join {src} s
  on s.technique=g.t and (s.label=0 or s.generator=g.g)), """


@query("metrics_by_generator", f"with {ALL}{_BY_GEN.format(src='allt')}{metrics_sql('pairs', 'technique, generator')} "
       f"select technique, generator, {M_COLS} from m")
def metrics_by_generator(spark, d):
    return metrics.report(metrics.evaluate_by_generator(scored_all(spark, d), ["technique"]),
                          ["technique", "generator"])


@query("auc_line_items", f"with {BIG}, {metrics_sql('big', 'technique')} select technique, n_samples, "
       "round(auc,6) as auc from m")
def auc_line_items(spark, d):
    return rounded(metrics.auc(scored_big(spark, d), ["technique"]), "auc")


@query("generator_metrics_line_items", f"with {BIG}{_BY_GEN.format(src='big')}{metrics_sql('pairs', 'technique, generator')} "
       f"select technique, generator, {M_COLS} from m")
def generator_metrics_line_items(spark, d):
    return metrics.report(metrics.evaluate_by_generator(scored_big(spark, d), ["technique"]),
                          ["technique", "generator"])


@query("roc_curve", f"""with {LONG}, h as (select technique, score, sum(label) p, sum(1-label) r from long group by 1,2),
c as (select *, sum(p) over w tp, sum(r) over w fp, lead(p) over o np, lead(r) over o nr,
  row_number() over o rn, sum(p) over (partition by technique) tot_p, sum(r) over (partition by technique) tot_r
  from h window w as (partition by technique order by score desc rows unbounded preceding),
  o as (partition by technique order by score desc))
select technique, round(score,6) as threshold, round(fp/tot_r,6) as fpr, round(tp/tot_p,6) as tpr from c
  where rn=1 or np is null or np<>p or nr<>r
union all select distinct technique, null, 0.0, 0.0 from c""")
def roc_curve(spark, d):
    return rounded(curves.roc_points(scored_long(spark, d), ["technique"]), "threshold", "fpr", "tpr")


_RESAMPLES = 20


@query("bootstrap_interval_hashed", f"""with {LONG},
idx as (select technique, label, score, row_number() over (partition by technique, label order by md5('42|'||sample_id), sample_id)-1 as k,
  count(*) over (partition by technique, label) as n from long),
draws as (select technique, label, b, ('0x'||substr(md5('42|'||b||'|'||label||'|'||k),1,15))::bigint % n as k, count(*) as w
  from idx, range(1,{_RESAMPLES + 1}) t(b) group by 1,2,3,4),
s as (select d.technique, d.b, i.score, sum(case when i.label=1 then w else 0 end) p, sum(case when i.label=0 then w else 0 end) r
  from draws d join idx i using (technique,label,k) group by 1,2,3),
c as (select *, sum(r) over (partition by technique,b order by score rows unbounded preceding)-0.5*r as below from s),
a as (select technique, b, sum(p*below)/(sum(p)*sum(r)) as auc from c group by 1,2)
select technique, round(quantile_cont(auc,0.025),6) as ci_low, round(quantile_cont(auc,0.975),6) as ci_high from a group by 1""")
def bootstrap_interval_hashed(spark, d):
    return rounded(curves.bootstrap_interval_hashed(
        scored_long(spark, d), ["technique"], n_resamples=_RESAMPLES), "ci_low", "ci_high")


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    return rounded(curves.bootstrap_interval(scored_long(spark, d), ["technique"]), "ci_low", "ci_high")


@query("bootstrap_class_sizes", f"""with {LONG} select technique, 1000::bigint as n_replicates, sum(label)::bigint as p_min, sum(label)::bigint as p_max,
 sum(1-label)::bigint as r_min, sum(1-label)::bigint as r_max from long group by 1""")
def bootstrap_class_sizes(spark, d):
    """Every replicate draws as many fakes and reals as there are."""
    drawn = curves.bootstrap_replicates(scored_long(spark, d), ["technique"])
    return drawn.groupBy("technique").agg(F.count("*").alias("n_replicates"), F.min("p").alias("p_min"), F.max("p").alias("p_max"),
                                          F.min("r").alias("r_min"), F.max("r").alias("r_max"))


# The normal tail in SQL, by the same published approximation.
_P = ("(tt*exp(-zz*zz + (((((((((0.17087277*tt-0.82215223)*tt+1.48851587)*tt-1.13520398)*tt+0.27886807)*tt"
      "-0.18628806)*tt+0.09678418)*tt+0.37409196)*tt+1.00002368)*tt-1.26551223)))")


def _delong_one(a: str, b: str, source: str = "wide", tag: tuple[str, str] | None = None) -> str:
    mid = lambda c: (f"rank() over (order by {c}) + (count(*) over (partition by {c})-1)/2.0 "
                     f"- rank() over (partition by label order by {c}) - (count(*) over (partition by label,{c})-1)/2.0")
    ta, tb = tag or (a.upper(), b.upper())
    return f"""select '{ta}' as technique_a, '{tb}' as technique_b, round(auc_a,6) auc_a, round(auc_b,6) auc_b,
  round(auc_a-auc_b,6) as difference, round(z,6) as z, round({_P},6) as p_value from (
  select *, 1/(1+0.5*zz) as tt from (select *, abs(z)/sqrt(2.0) as zz from (
  select *, case when v>0 then (auc_a-auc_b)/sqrt(v) end as z from (
  select avg(va) filter (label=1) auc_a, avg(vb) filter (label=1) auc_b,
    var_samp(va-vb) filter (label=1)/count(*) filter (label=1)
    + var_samp(va-vb) filter (label=0)/count(*) filter (label=0) as v from (
  select label, case when label=1 then qa/k else 1-qa/m end va, case when label=1 then qb/k else 1-qb/m end vb from (
  select label, {mid(a)} as qa, {mid(b)} as qb, count(*) filter (label=1) over () m, count(*) filter (label=0) over () k
  from {source} where {a} is not null and {b} is not null))))))"""


@query("delong_comparison", f"with {WIDE} " + " union all ".join(_delong_one("t05", t) for t in ("t01", "t02", "t03", "t04")))
def delong_comparison(spark, d):
    return rounded(curves.delong_pairs(scored_all(spark, d), [("T05", t) for t in BASE]),
                   "auc_a", "auc_b", "difference", "z", "p_value")


_HITS = WIDE + """, hit as (select *, (t01>=0.5)=(label=1) h1, (t02>=0.5)=(label=1) h2, (t03>=0.5)=(label=1) h3,
  (t04>=0.5)=(label=1) h4, (t05>=0.5)=(label=1) h5 from wide where t04 is not null),
hits as (select *, h1::int+h2::int+h3::int+h4::int as n_hits from hit)"""


def _hits(spark, d):
    matrix = errors.score_matrix(scored_all(spark, d), TECHNIQUE_ORDER, carry=["label", "generator"])
    return errors.hits(matrix, TECHNIQUE_ORDER, BASE)


@query("score_matrix", f"with {WIDE} select sample_id, label, generator, round(t01,6) as \"T01\", round(t02,6) as \"T02\", "
       "round(t03,6) as \"T03\", round(t04,6) as \"T04\" from wide")
def score_matrix(spark, d):
    m = errors.score_matrix(scored_long(spark, d), BASE, carry=["label", "generator"])
    return rounded(m, *BASE)


@query("all_wrong_by_generator", f"with {_HITS} select generator, count(*) n, count(*) filter (n_hits=0) all_wrong, "
       "round(count(*) filter (n_hits=0)/count(*),6) as rate from hits group by 1 order by rate desc, generator")
def all_wrong_by_generator(spark, d):
    return rounded(errors.all_wrong_by_generator(_hits(spark, d)), "rate")


@query("pairwise_disagreement", f"with {_HITS} " + " union all ".join(
    f"select 'T0{a}_T0{b}' as pair, round(avg((h{a}<>h{b})::int),6) as rate from hits"
    for a in range(1, 5) for b in range(a + 1, 5)))
def pairwise_disagreement(spark, d):
    return rounded(errors.disagreement(_hits(spark, d), BASE), "rate")


@query("hit_distribution", f"with {_HITS} select n_hits, count(*) n from hits group by 1")
def hit_distribution(spark, d):
    return errors.hit_distribution(_hits(spark, d))


@query("fusion_rescue", f"with {_HITS} " + " union all ".join(
    f"select 'T0{a}' technique, count(*) filter (not h{a}) errors, count(*) filter (not h{a} and h5) rescued, "
    f"round(count(*) filter (not h{a} and h5)/count(*) filter (not h{a}),6) as rate from hits" for a in range(1, 5)))
def fusion_rescue(spark, d):
    return rounded(errors.fusion_rescue(_hits(spark, d), BASE), "rate")


@query("fusion_spoil", f"with {_HITS} select count(*) filter (n_hits>=2 and not h5) spoiled, count(*) n, "
       "round(count(*) filter (n_hits>=2 and not h5)/count(*),6) as rate from hits")
def fusion_spoil(spark, d):
    return rounded(errors.fusion_spoil(_hits(spark, d), BASE), "rate")


_GEN_AUC = f"with {ALL}{_BY_GEN.format(src='allt')}{metrics_sql('pairs', 'technique, generator')}, " \
           "ga as (select technique, generator, auc, recall, tp+fn as n from m where tp+fn>=30) "


@query("auc_by_generator", _GEN_AUC + "select technique, generator, round(auc,6) auc, round(recall,6) recall, n from ga")
def auc_by_generator(spark, d):
    return rounded(errors.auc_by_generator(scored_all(spark, d)), "auc", "recall")


@query("inversions", _GEN_AUC + "select technique, generator, round(auc,6) auc, round(recall,6) recall, n from ga "
       "where auc<0.5 order by 3, 1, 2")
def inversions(spark, d):
    return rounded(errors.inversions(errors.auc_by_generator(scored_all(spark, d))), "auc", "recall")


@query("low_recall_without_inversion", _GEN_AUC + "select count(*) filter (recall<0.5 and auc>=0.5) n_cases from ga")
def low_recall_without_inversion(spark, d):
    return errors.low_recall_without_inversion(errors.auc_by_generator(scored_all(spark, d)))


@query("error_examples", f"""with {_HITS}, e as (select sample_id, 'all_wrong' as category from hits where n_hits=0
  union all select sample_id, 'only_fusion_right' from hits where n_hits=0 and h5),
r as (select *, row_number() over (partition by category order by sample_id) as rank from e)
select sample_id, category, rank from r where rank<=15""")
def error_examples(spark, d):
    return errors.examples(_hits(spark, d))


# Report of the job, query with its SQL, key and value.
_REPORTS = (("distribution", "hit_distribution", "n_hits", "n"), ("rescue", "fusion_rescue", "technique", "rescued"),
            ("disagreement", "pairwise_disagreement", "pair", "rate"), ("all_wrong", "all_wrong_by_generator", "generator", "all_wrong"),
            ("auc_by_generator", "auc_by_generator", "technique || '/' || generator", "auc"),
            ("inversions", "inversions", "technique || '/' || generator", "auc"))


@query("error_analysis_job", " union all ".join(
    f"select '{report}' as report, ({key})::varchar as key, round(({value})::double, 6) as value from ({ORACLES[name]})" for report, name, key, value in _REPORTS))
def error_analysis_job(spark, d):
    """Every keyed report of the job, written and read back as one table."""
    reports = evaluation.error_analysis(scored_all(spark, d), BASE)
    rows = [reports[report].select(F.lit(report).alias("report"), F.expr(f"cast({key} as string)").alias("key"),
                                   F.round(F.col(value).cast("double"), 6).alias("value")) for report, _, key, value in _REPORTS]
    path = shared_dir(spark, "errors")
    sinks.write_table(reduce(lambda a, b: a.unionByName(b), rows), path, "parquet")
    return spark.read.parquet(path)


_RAW = WIDE + """, raw as (select technique, sample_id, s as score from (
  select 'T01' technique, sample_id, t01*8-4 s from wide union all
  select 'T02', sample_id, t02 from wide union all
  select 'T03', sample_id, t03+0.5 from wide union all
  select 'T04', sample_id, t04 from wide where t04 is not null))"""


def _raw(spark, d):
    s = scored_long(spark, d).select("technique", "sample_id", "score")
    return s.withColumn("score", F.when(F.col("technique") == "T01", F.col("score") * 8 - 4)
                        .when(F.col("technique") == "T03", F.col("score") + 0.5).otherwise(F.col("score")))


@query("normalised_scores", f"""with {_RAW}, b as (select technique, min(score)<0 or max(score)>1 as logit from raw group by 1)
select technique, sample_id, round(case when logit then 1/(1+exp(-score)) else score end,6) as score from raw join b using (technique)""")
def normalised_scores(spark, d):
    return rounded(filters.normalise_scores(_raw(spark, d), ["technique"]), "score")


@query("score_validation", f"""with {_RAW}, c as (select technique, count(*) n, 0::bigint n_not_finite,
  count(*) filter (score<0 or score>1) n_out_of_range, (select count(*) from events) n_expected from raw group by 1)
select *, case when n<>n_expected then 'wrong length' when n_out_of_range>0 then 'out of range' else '' end as error,
 case when n<>n_expected or n_out_of_range>0 then 'erro' else 'ok' end as status from c""")
def score_validation(spark, d):
    return filters.validate_scores(_raw(spark, d), ["technique"], table(spark, d, "events"))


# Runs: condition and seed derived from the sample.
_RUNS = LONG + """, runs as (select *, case when sample_id%3=0 then 'clean' when sample_id%3=1 then 'jpeg_q50' else 'noise_sigma1' end as condition,
  (['42','123','456'])[(sample_id//3)%3+1]::int as seed,
  case when sample_id%2=0 then 'standard' else 'ood' end as protocol from long)"""


def runs(spark, d):
    i = F.col("sample_id")
    return scored_long(spark, d).withColumns({
        "condition": F.element_at(F.array(F.lit("clean"), F.lit("jpeg_q50"), F.lit("noise_sigma1")), (F.pmod(i, F.lit(3)) + 1).cast("int")),
        "seed": F.element_at(F.array(F.lit(42), F.lit(123), F.lit(456)), (F.pmod(F.floor(i / 3), F.lit(3)) + 1).cast("int")),
        "protocol": F.when(F.pmod(i, F.lit(2)) == 0, F.lit("standard")).otherwise(F.lit("ood"))})


@query("protocol_run", f"with {_RUNS}, {metrics_sql('runs', 'protocol, technique, condition')} select protocol, technique, condition, "
       "case technique when 'T01' then 'RGB co-occurrence CNN' when 'T02' then 'Spectral learning' "
       "when 'T03' then 'Benford law on DCT' else 'Projective geometry' end technique_name, 'ok' status, '' error, '' seed, "
       f"{M_COLS} from m")
def protocol_run(spark, d):
    overall, _ = evaluation.run_protocol(runs(spark, d))
    return metrics.report(overall, ["protocol", "technique", "condition", "technique_name", "status", "error", "seed"])


@query("protocol_run_by_generator", f"""with {_RUNS}, gens as (select distinct protocol p, technique t, condition c, generator g from runs where label=1),
pairs as (select p as protocol, t as technique, c as condition, g as generator, s.label, s.score from gens join runs s
 on s.protocol=p and s.technique=t and s.condition=c and (s.label=0 or s.generator=g)),
{metrics_sql('pairs', 'protocol, technique, condition, generator')} select protocol, technique, condition, generator, {M_COLS} from m""")
def protocol_run_by_generator(spark, d):
    _, by_generator = evaluation.run_protocol(runs(spark, d))
    return metrics.report(by_generator, ["protocol", "technique", "condition", "generator"])


@query("robustness_table", f"""with {_RUNS}, {metrics_sql('runs', 'technique, condition')}
select a.technique, a.condition, a.n_samples, round(a.auc,6) auc, round(c.auc,6) clean_auc, round(a.auc-c.auc,6) as change
from m a join m c on a.technique=c.technique and c.condition='clean'""")
def robustness_table(spark, d):
    return rounded(evaluation.robustness(runs(spark, d)), "auc", "clean_auc", "change")


@query("condition_auc_table", f"""with {_RUNS}, {metrics_sql('runs', 'technique, condition')}
select condition, """ + ", ".join(f"round(max(auc) filter (technique='{t}'),6) as \"{t}\"" for t in BASE) +
       " from m group by 1 order by condition<>'clean', condition")
def condition_auc_table(spark, d):
    return rounded(evaluation.condition_table(runs(spark, d), BASE), *BASE)


@query("generator_auc_table", f"with {LONG}{_BY_GEN.format(src='long')}{metrics_sql('pairs', 'technique, generator')} select generator, " +
       ", ".join(f"round(max(auc) filter (technique='{t}'),6) as \"{t}\"" for t in BASE) + " from m group by 1")
def generator_auc_table(spark, d):
    return rounded(evaluation.figure_tables(scored_long(spark, d), BASE)["generator_auc"], *BASE)


@query("multi_seed_summary", f"""with {_RUNS}, {metrics_sql('runs', 'technique, seed')}
select technique, count(auc) n_runs, round(avg(auc),6) auc_mean, round(coalesce(stddev_samp(auc),0),6) auc_sd,
 round(avg(accuracy),6) accuracy_mean, round(coalesce(stddev_samp(accuracy),0),6) accuracy_sd from m group by 1""")
def multi_seed_summary(spark, d):
    _, summary = evaluation.multi_seed(runs(spark, d))
    return rounded(summary, "auc_mean", "auc_sd", "accuracy_mean", "accuracy_sd")


@query("missing_runs", f"""with {_RUNS}, done as (select distinct technique, seed from runs where technique in ('T01','T02') and seed<>456)
select t.technique, s.seed from (values ('T01'),('T02'),('T03'),('T04')) t(technique), (values (42),(123),(456)) s(seed)
where not exists (select 1 from done d where d.technique=t.technique and d.seed=s.seed)""")
def missing_runs(spark, d):
    done = runs(spark, d).filter("technique in ('T01','T02') and seed <> 456")
    return evaluation.missing_runs(spark, done, BASE)


@query("protocol_drop", f"""with {_RUNS}, {metrics_sql('runs', 'protocol, technique')} select technique,
 round(max(auc) filter (protocol='standard'),6) auc_before, round(max(auc) filter (protocol='ood'),6) auc_after,
 round(max(auc) filter (protocol='ood')-max(auc) filter (protocol='standard'),6) as change from m group by 1""")
def protocol_drop(spark, d):
    m = metrics.evaluate(runs(spark, d), ["protocol", "technique"])
    return rounded(summaries.protocol_drop(m, "standard", "ood"), "auc_before", "auc_after", "change")


_VARIANTS = WIDE + """, var as (select sample_id, label, generator, 'A' variant, t05 as score from wide union all
 select sample_id, label, generator, 'B', (t01+t02)/2 from wide)"""


def variants(spark, d):
    return scored_wide(spark, d).select(
        "sample_id", "label", "generator", F.col("t05").alias("A"), ((F.col("t01") + F.col("t02")) / 2).alias("B")
    ).unpivot(["sample_id", "label", "generator"], ["A", "B"], "variant", "score")


@query("calibration_variants", f"""with {_VARIANTS}, {metrics_sql('var', 'variant')},
u as (select variant, metric, v from m, lateral (values ('accuracy',accuracy),('f1',f1),('auc',auc),('fpr',fpr),('fnr',fnr)) x(metric,v))
select metric, round(max(v) filter (variant='A'),6) value_a, round(max(v) filter (variant='B'),6) value_b,
 round(max(v) filter (variant='B')-max(v) filter (variant='A'),6) as delta from u group by 1""")
def calibration_variants(spark, d):
    m = metrics.evaluate(variants(spark, d), ["variant"])
    return rounded(summaries.variant_comparison(m, "A", "B", ["accuracy", "f1", "auc", "fpr", "fnr"]),
                   "value_a", "value_b", "delta")


@query("calibration_variant_test", f"with {WIDE}, w2 as (select *, (t01+t02)/2 as vb from wide) "
       + _delong_one("t05", "vb", "w2", ("A", "B")))
def calibration_variant_test(spark, d):
    return rounded(curves.delong_pairs(variants(spark, d), [("A", "B")], technique="variant"),
                   "auc_a", "auc_b", "difference", "z", "p_value")


_WIDE_B = WIDE + ", w2 as (select *, (t01+coalesce(t02,0.0))/2 as t05b from wide)"


@query("significance_job", f"with {_WIDE_B} select *, p_value<0.05 as significant from (" +
       " union all ".join(_delong_one(v, t, "w2", (n, t.upper())) for v, n in (("t05", "T05"), ("t05b", "T05B")) for t in ("t01", "t02", "t03")) + ")")
def significance_job(spark, d):
    """Both fusion variants against each base technique."""
    s = scored_all(spark, d)
    both = scored_wide(spark, d).select("sample_id", "label", "generator", F.lit("T05B").alias("technique"),
                                        ((F.col("t01") + F.coalesce("t02", F.lit(0.0))) / 2).alias("score"))
    tests = evaluation.significance_tests(s.unionByName(both), ["T05", "T05B"], ["T01", "T02", "T03"])
    return rounded(tests, "auc_a", "auc_b", "difference", "z", "p_value")


@query("significance_intervals")
def significance_intervals(spark, d):
    """The intervals of the job, 1,000 replicates, beside the AUC that each is of."""
    s = scored_all(spark, d)
    intervals, _ = evaluation.significance(s, ["T05"], ["T01"])
    return rounded(metrics.auc(s, ["technique"]).select("technique", "auc").join(intervals, "technique"), "auc", "ci_low", "ci_high")


@query("latency_summary", """select event_type, count(value) n, round(avg(value),6) mean_ms, round(coalesce(stddev_samp(value),0),6) sd_ms,
 max(value) max_ms, round(median(value),6) median_ms, avg(value)<30000 as passed from events group by 1""")
def latency_summary(spark, d):
    return rounded(summaries.latency(table(spark, d, "events"), ["event_type"], "value"), "mean_ms", "sd_ms", "median_ms")


@query("latency_total", """select round(sum(a),6) total_ms, sum(a)<30000 as passed from (select avg(value) a from events group by event_type)""")
def latency_total(spark, d):
    return rounded(summaries.total_latency(summaries.latency(table(spark, d, "events"), ["event_type"], "value")), "total_ms")


@query("repetition_summary", f"""with {_RUNS}, {metrics_sql('runs', 'technique, seed')}
select technique, count(auc) n_runs, round(avg(auc),6) auc_mean, round(coalesce(stddev_samp(auc),0),6) auc_sd from m group by 1""")
def repetition_summary(spark, d):
    return rounded(summaries.mean_and_sd(metrics.auc(runs(spark, d), ["technique", "seed"]), ["technique"], ["auc"]),
                   "auc_mean", "auc_sd")


@query("scalar_predictor", """with s as (select label, n_chars as score from (select n_chars, case when cast(regexp_extract(source,'([0-9]+)',1) as int)<=4 then 0 else 1 end as label from documents)),
r as (select *, rank() over (order by score)+(count(*) over (partition by score)-1)/2.0 mid from s)
select count(*) n_samples, round((sum(mid) filter (label=1)-count(*) filter (label=1)*(count(*) filter (label=1)+1)/2.0)
 /(count(*) filter (label=1)*count(*) filter (label=0)),6) as auc, max(score)::double as max, count(*) filter (score>250) n_above, median(score)::double as median from r""")
def scalar_predictor(spark, d):
    from ..bindings import entries
    return rounded(summaries.scalar_summary(entries(spark, d), "size", 250), "auc")
