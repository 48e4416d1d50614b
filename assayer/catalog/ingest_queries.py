"""Score ingest, component tables, published values, sinks, arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import components, entries, masks, scored_all, scored_long, scored_wide, table
from ..constants import COMPONENTS, SOURCE_TECHNIQUES
from ..operators import components as comp
from ..operators import errors, features, filters, metrics, summaries
from ..plans import evaluation
from ..session import materialize, shared_dir
from ..sources import readers, sinks
from ..streaming import arrivals
from .metric_queries import _RUNS, rounded, runs
from .registry import ALL, BLOCKS, COMPONENTS as CTE, ENTRIES, LONG, MASKS, M_COLS, WIDE, metrics_sql, query

def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _consolidated(spark, d):
    """The consolidated table is a written artefact; every report reads it."""
    return materialize(comp.consolidate(components(spark, d)), "component_table")


def _named(spark, d):
    """Event scores as an external file would carry them: folder paths and text cells."""
    w = scored_wide(spark, d)
    path = F.concat(F.lit("out\\run\\event_"), F.col("sample_id").cast("string"), F.lit(".png"))
    return w.select(path.alias("image"), F.col("t01").alias("prediction"), F.lit("x").alias("note"))


def _event_entries(spark, d):
    return scored_wide(spark, d).select(
        "sample_id", F.concat(F.lit("fake/a/event_"), F.col("sample_id").cast("string"), F.lit(".png")).alias("path"))


@query("external_scores", f"with {WIDE} select 'event_'||sample_id||'.png' as name, round(t01,6) as score from wide")
def external_scores(spark, d):
    folder = shared_dir(spark, "external")
    sinks.write_table(_named(spark, d).repartition(partitions(spark), "image"), folder)
    return rounded(readers.read_scores(spark, folder), "score")


@query("aligned_scores", f"with {WIDE} select sample_id, 'event_'||sample_id||'.png' as name, case when sample_id%7<>0 then round(t01,6) end as score from wide")
def aligned_scores(spark, d):
    scores = _named(spark, d).withColumnsRenamed({"prediction": "score", "image": "path"}).drop("note")
    keep = F.regexp_extract("path", r"_(\d+)\.", 1).cast("bigint") % 7 != 0
    return rounded(comp.align_by_name(_event_entries(spark, d), scores.filter(keep)).select("sample_id", "name", "score"), "score")


@query("alignment_completeness", """select count(*) n, count(*) filter (event_id%7=0) n_missing,
 (select string_agg(x, ',' order by x) from (select 'event_'||event_id||'.png' as x from events where event_id%7=0 order by x limit 3)) as first_missing from events""")
def alignment_completeness(spark, d):
    scores = _named(spark, d).withColumnsRenamed({"prediction": "score", "image": "path"}).drop("note")
    keep = F.regexp_extract("path", r"_(\d+)\.", 1).cast("bigint") % 7 != 0
    return comp.completeness(comp.align_by_name(_event_entries(spark, d), scores.filter(keep)))


@query("positional_scores", f"with {WIDE} select sample_id, round(t01,6) as score from wide")
def positional_scores(spark, d):
    folder = shared_dir(spark, "positional")
    ordered = scored_wide(spark, d).select("sample_id", F.col("t01").alias("score"))
    sinks.write_table(ordered.repartitionByRange(partitions(spark), "sample_id").sortWithinPartitions("sample_id").select("score"), folder)
    got = readers.by_position(ordered.select("sample_id"), readers.read_scores(spark, folder), "sample_id")
    return rounded(got.select("sample_id", "score"), "score")


@query("component_table", f"with {CTE} select name, split, label, round(perspective_fields,6) perspective_fields, round(line_segment,6) line_segment, round(object_shadow,6) object_shadow from ctable")
def component_table(spark, d):
    path = shared_dir(spark, "components")
    sinks.write_table(comp.consolidate(components(spark, d)), path)
    return rounded(readers.read_components(spark, path), *COMPONENTS)


@query("legacy_component_table", f"with {CTE} select name, split, label, null::double perspective_fields, null::double line_segment, round(score,6) as object_shadow from cos")
def legacy_component_table(spark, d):
    path = shared_dir(spark, "legacy")
    sinks.write_table(components(spark, d)["object_shadow"].withColumnRenamed("score", "legacy_score"), path)
    return rounded(readers.read_components(spark, path), *COMPONENTS)


@query("component_files", f"with {CTE} select name, split, label, round(case when split='test' then score/2 else score end,6) as score from cos")
def component_files(spark, d):
    """Split files, a later rerun of the test split, a failure log and a foreign layout."""
    root = shared_dir(spark, "files")
    t = components(spark, d)["object_shadow"].withColumnRenamed("score", "value")
    again = t.filter("split = 'test'").withColumn("value", F.col("value") / 2)
    for folder, part in (("a_run", t), ("b_rerun", again), ("z_other", t.select("name", "split", "label", F.lit(9.0).alias("other")))):
        sinks.write_table(part, f"{root}/{folder}")
    rows = readers.read_component_files(spark, f"{root}/*", "value", by="path")
    return rounded(rows, "score")


@query("consolidated_components", f"with {CTE} select name, split, label, round(perspective_fields,6) perspective_fields, round(line_segment,6) line_segment, round(object_shadow,6) object_shadow from ctable order by split, name")
def consolidated_components(spark, d):
    return rounded(comp.consolidate(components(spark, d)), *COMPONENTS).orderBy("split", "name")


_AGG = f"""with {CTE}, u as (select *, (select avg(x) from (values (perspective_fields),(line_segment),(object_shadow)) t(x)) as mean from ctable)"""


@query("component_mean_and_max", _AGG + " select name, round(coalesce(mean,0.5),6) as mean, round(coalesce(greatest(perspective_fields,line_segment,object_shadow),0.5),6) as max from u")
def component_mean_and_max(spark, d):
    t = _consolidated(spark, d)
    return t.select("name", F.round(comp.aggregate_components(), 6).alias("mean"),
                    F.round(comp.aggregate_components(how="max"), 6).alias("max"))


@query("component_coverage", f"with {CTE}, n as (select count(*) n_rows, count(perspective_fields) a, count(line_segment) b, count(object_shadow) c, "
       "count(*) filter (perspective_fields is not null and line_segment is not null and object_shadow is not null) e from ctable) "
       "select n_rows, component, n, round(n/n_rows,6) as share from n, lateral (values ('perspective_fields',a),('line_segment',b),('object_shadow',c),('all_components',e)) v(component,n)")
def component_coverage(spark, d):
    return rounded(comp.coverage(_consolidated(spark, d)), "share")


@query("component_metrics", _AGG + f""", cl as (select label, 'perspective_fields' component, perspective_fields score from u union all select label, 'line_segment', line_segment from u
 union all select label, 'object_shadow', object_shadow from u union all select label, 'aggregate', mean from u), {metrics_sql('cl', 'component')}
select component, {M_COLS}, round(n_samples/(select count(*) from ctable),6) as coverage, '' as note from m""")
def component_metrics(spark, d):
    return comp.component_metrics(_consolidated(spark, d))


@query("normalised_components", f"""with {CTE}, raw as (select name, 'line_segment' component, line_segment*6-3 score from ctable union all select name, 'object_shadow', object_shadow from ctable),
b as (select component, min(score)<0 or max(score)>1 as logit from raw group by 1)
select name, component, round(case when logit then 1/(1+exp(-score)) else score end,6) as score from raw join b using (component)""")
def normalised_components(spark, d):
    t = _consolidated(spark, d)
    long = t.withColumn("line_segment", F.col("line_segment") * 6 - 3).unpivot("name", ["line_segment", "object_shadow"], "component", "score")
    return rounded(filters.normalise_scores(long, ["component"]), "score")


@query("known_images", f"with {CTE} select 'event_'||event_id as name, case when t.name is null then 'unknown' else 'known' end as status, round(perspective_fields,6) as perspective_fields from events e left join ctable t on t.name='event_'||event_id")
def known_images(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("name"))
    k = comp.known_images(e, _consolidated(spark, d))
    return k.select("name", "status", F.round("perspective_fields", 6).alias("perspective_fields"))


_EMPTY = WIDE + ", er as (select label, t01 as score, sample_id%4=0 as is_empty from wide)"
_EMPTY_AUC = ", er3 as (select 'all' as part, label, score from er union all select case when is_empty then 'empty' else 'content' end, label, score from er), "


@query("empty_input_confounder", f"""with {_EMPTY}{_EMPTY_AUC}{metrics_sql('er3', 'part')},
w as (select max(auc) filter (part='all') auc_all, max(auc) filter (part='content') auc_content, max(auc) filter (part='empty') auc_empty from m),
q as (select count(*) n, count(*) filter (is_empty) n_empty, round(avg(is_empty::int),6) empty_rate, round(avg(is_empty::int) filter (label=0),6) empty_rate_real,
 round(avg(is_empty::int) filter (label=1),6) empty_rate_fake from er)
select q.*, round(auc_all,6) auc_all, round(auc_content,6) auc_content, round(auc_empty,6) auc_empty, round(auc_content-auc_all,6) as change,
 case when auc_content-auc_all < -0.03 then 'shortcut' when auc_content-auc_all>0.03 then 'noise' else 'no effect' end as verdict from q, w""")
def empty_input_confounder(spark, d):
    rows = scored_wide(spark, d).select("label", F.col("t01").alias("score"), (F.pmod("sample_id", F.lit(4)) == 0).alias("is_empty"))
    return rounded(comp.empty_input_confounder(rows), "empty_rate", "empty_rate_real", "empty_rate_fake", "auc_all", "auc_content", "auc_empty", "change")


@query("empty_pairs", f"""with {MASKS}, lv as (select sample, klass, max(floor(greatest(value*2-1,0)*100)) as top from mask group by 1,2),
p as (select sample, max(top) filter (klass=0) as object_max, max(top) filter (klass=1) as shadow_max from lv group by 1)
select *, object_max<=20 or shadow_max<=20 as either, object_max=0 or shadow_max=0 as either_zero, object_max=0 and shadow_max=0 as both_zero from p""")
def empty_pairs(spark, d):
    level = F.floor(F.greatest(F.col("value") * 2 - 1, F.lit(0.0)) * 100)
    pick = lambda k: F.max(F.when(F.col("klass") == k, level)).cast("double")
    p = masks(spark, d).groupBy("sample").agg(pick(0).alias("object_max"), pick(1).alias("shadow_max"))
    return p.select("*", *[filters.empty_pair(F.col("object_max"), F.col("shadow_max"), r).alias(r)
                           for r in ("either", "either_zero", "both_zero")])


_PARITY = CTE + """, svc as (select name, perspective_fields, case when hash_no%11=0 then null else line_segment+case when hash_no%6=0 then 0.01 else 0.0001 end end as line_segment, object_shadow
 from (select *, split_part(name,'_',2)::bigint as hash_no from ctable) where hash_no%13<>0),
ex as (select name, 'perspective_fields' component, perspective_fields expected from ctable union all select name, 'line_segment', line_segment from ctable union all select name, 'object_shadow', object_shadow from ctable),
ac as (select name, 'perspective_fields' component, perspective_fields actual from svc union all select name, 'line_segment', line_segment from svc union all select name, 'object_shadow', object_shadow from svc),
par as (select ex.name, ex.component, expected, actual, abs(actual-expected) as diff, case when s.name is null then 'failed' when actual is null or abs(actual-expected)>0.001 then 'divergent' else 'equal' end as outcome
 from ex left join ac using (name, component) left join (select distinct name from svc) s on s.name=ex.name where expected is not null)"""


def _parity(spark, d):
    batch = _consolidated(spark, d).select("name", *COMPONENTS)
    no = F.split("name", "_")[1].cast("bigint")
    moved = F.col("line_segment") + F.when(no % 6 == 0, 0.01).otherwise(0.0001)
    service = batch.filter(no % 13 != 0).withColumn("line_segment", F.when(no % 11 != 0, moved))
    return comp.service_parity(batch, service)


@query("service_parity", f"with {_PARITY} select name, component, round(expected,6) expected, round(actual,6) actual, round(diff,6) diff, outcome from par")
def service_parity(spark, d):
    return rounded(_parity(spark, d), "expected", "actual", "diff")


@query("service_parity_summary", f"""with {_PARITY} select coalesce(component,'all') as component, count(diff) compared, count(*) filter (outcome='divergent') divergent, count(*) filter (outcome='failed') failed,
 round(coalesce(max(diff),0),6) max_diff, case when count(*) filter (outcome<>'equal')=0 then 'parity' else 'no parity' end as verdict from par group by rollup(component)""")
def service_parity_summary(spark, d):
    return rounded(comp.parity_summary(_parity(spark, d)), "max_diff")


@query("subset_evaluation", f"""with {WIDE}, sub as (select (['easy','unconfident','misclassified'])[sample_id%3+1] as subset, label, t02 as score from wide), {metrics_sql('sub', 'subset')}
select subset, n_samples, fn+tp as n_fake, tn+fp as n_real, round(accuracy,6) accuracy, round(auc,6) auc, tn, fp, fn, tp from m""")
def subset_evaluation(spark, d):
    name = F.element_at(F.array(F.lit("easy"), F.lit("unconfident"), F.lit("misclassified")), (F.pmod("sample_id", F.lit(3)) + 1).cast("int"))
    rows = scored_wide(spark, d).select(name.alias("subset"), "label", F.col("t02").alias("score"))
    e = comp.subset_evaluation(rows)
    c = F.col("confusion")
    return rounded(e.select("*", c[0][0].alias("tn"), c[0][1].alias("fp"), c[1][0].alias("fn"), c[1][1].alias("tp")).drop("confusion"), "accuracy", "auc")


@query("component_job")
def component_job(spark, d):
    base = scored_long(spark, d, ("T01", "T02", "T03")).withColumns({
        "name": F.concat(F.lit("event_"), F.col("sample_id").cast("string")),
        "split": F.when(F.pmod("sample_id", F.lit(10)) < 7, F.lit("train")).when(F.pmod("sample_id", F.lit(10)) == 7, F.lit("val")).otherwise(F.lit("test"))})
    return evaluation.component_run(components(spark, d), base)["fusion_test"]


# Published values against AUC measured on document length.
_MEASURED = ENTRIES + f""", sc as (select label, generator, (size%1000)/1000.0 as score from ent), gl as (select distinct generator g from sc where label=1),
pr as (select g as generator, label, score from gl join sc on label=0 or generator=g), {metrics_sql('pr', 'generator')},
pub as (select * from (values ('glide',0.902,256),('stable_diffusion_1_3',0.996,512),('stable_diffusion_1_4',0.996,512),('flux',0.830,896),('dalle2',0.911,1024),
('stable_diffusion_2',0.965,1000),('stable_diffusion_xl',0.974,1000),('stable_diffusion_3',0.759,1024),('gigagan',0.854,1024),('midjourney_v5',0.945,1100),
('midjourney_v6_1',0.840,1040),('dalle3',0.902,1080),('adobe_firefly',0.960,2050)) v(generator,published_auc,native_side)),
gap as (select p.generator, native_side, native_side/256.0 as reduction, auc as measured_auc, published_auc::double as published_auc, (auc-published_auc::double)*100 as gap_pp, abs((auc-published_auc::double)*100)<=5 as within
 from pub p left join (select * from m where generator<>'flux') m on m.generator=p.generator)"""


def _gaps(spark, d):
    scored = entries(spark, d).withColumn("score", F.pmod("size", F.lit(1000)) / 1000.0).withColumn("k", F.lit(1))
    measured = metrics.evaluate_by_generator(scored, ["k"]).filter("generator <> 'flux'")
    return summaries.published_gap(measured, readers.published_table(spark))


@query("published_gap", f"with {_MEASURED} select generator, native_side, reduction::double reduction, round(measured_auc,6) measured_auc, published_auc, round(gap_pp,6) gap_pp, within from gap")
def published_gap(spark, d):
    return rounded(_gaps(spark, d), "measured_auc", "gap_pp")


@query("published_summary", f"""with {_MEASURED} select round(avg(measured_auc),6) mean_measured, round(avg(published_auc),6) mean_published, coalesce(string_agg(generator, ',' order by generator) filter (within),'') as within,
 round((avg(measured_auc)-avg(published_auc))*100,6) mean_gap_pp from gap where measured_auc is not null""")
def published_summary(spark, d):
    return rounded(summaries.published_summary(_gaps(spark, d)), "mean_measured", "mean_published", "mean_gap_pp")


@query("score_map", f"with {WIDE} select 'event_'||sample_id||'.png' as name, round(t01,6) as score from wide")
def score_map(spark, d):
    w = scored_wide(spark, d).withColumn("path", F.concat(F.lit("a/b/event_"), F.col("sample_id").cast("string"), F.lit(".png")))
    docs = w.groupBy(F.floor(F.col("sample_id") / 100).alias("g")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "t01")))).alias("value"))
    return rounded(readers.read_score_map(docs), "score")


@query("line_sets", "select 'img_'||vec_id as path, 16::bigint as n_lines, list_sum(list_transform(embedding, lambda v: floor(v::double*10000)::bigint))::bigint as total from embeddings")
def line_sets(spark, d):
    path = shared_dir(spark, "lines")
    lines = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    table(spark, d, "embeddings").select(F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("path"), lines.alias("lines")).write.parquet(path)
    flat = F.aggregate(F.flatten("lines"), F.lit(0).cast("bigint"), lambda a, v: a + F.floor(v.cast("double") * 10000))
    return readers.read_lines(spark, path).select("path", F.size("lines").cast("bigint").alias("n_lines"), flat.alias("total"))


@query("paired_items", "select doc_id from documents join labels using (doc_id)")
def paired_items(spark, d):
    return readers.pairs_present(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("paired_items_dropped", "select count(*) n_dropped from documents where doc_id not in (select doc_id from labels)")
def paired_items_dropped(spark, d):
    return readers.pairs_dropped(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("status_rows", """select event_type as technique, event_type as technique_name, case when event_id%3=0 then 'erro' else 'ok' end as status, case when event_id%3=0 then 'boom' else '' end as error,
 case when event_id%2=0 then '' else user_id::varchar end as seed, count(*) n from events group by all""")
def status_rows(spark, d):
    r = table(spark, d, "events").select(
        F.col("event_type").alias("technique"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("boom")).alias("error"),
        F.when(F.pmod("event_id", F.lit(2)) != 0, F.col("user_id")).alias("seed"))
    return filters.status_columns(r).groupBy("technique", "technique_name", "status", "error", "seed").agg(F.count("*").alias("n"))


@query("upload_verdicts", """with u as (select page_id, 'f'||page_id||(['.png','.JPG','.webp','.tiff','.png'])[page_id%5+1] as path, octet_length(encode(html))*case when page_id%6=0 then 5000 else 1 end as len,
 case page_id%4 when 0 then '89504E470D0A1A0A00000000' when 1 then 'FFD8FFE000104A4649460001' when 2 then '424D36000000000000003600' else upper(substr(hex(html),1,24)) end as magic from pages)
select page_id, case when len>10485760 then 'too large' when page_id%5=3 then 'suffix not allowed' when page_id%4 in (0,1) then 'ok' when page_id%4=2 then 'content not allowed' else 'corrupt or unknown' end as reason from u""")
def upload_verdicts(spark, d):
    return _uploads(table(spark, d, "pages")).select(
        "page_id", filters.upload_verdict(F.col("path"), F.col("length"), F.col("magic")).alias("reason"))


def _uploads(pages):
    i = F.col("page_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".webp", ".tiff", ".png")]), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    magic = (F.when(F.pmod(i, F.lit(4)) == 0, F.lit("89504E470D0A1A0A00000000")).when(F.pmod(i, F.lit(4)) == 1, F.lit("FFD8FFE000104A4649460001"))
             .when(F.pmod(i, F.lit(4)) == 2, F.lit("424D36000000000000003600")).otherwise(F.hex(F.substring(F.col("html").cast("binary"), 1, 12))))
    return pages.select("page_id", F.concat(F.lit("f"), i.cast("string"), ext).alias("path"),
                        (F.octet_length("html") * F.when(F.pmod(i, F.lit(6)) == 0, 5000).otherwise(1)).alias("length"), magic.alias("magic"))


@query("arrival_validation", """with u as (select page_id, octet_length(encode(html))*case when page_id%6=0 then 5000 else 1 end as len from pages)
select case when len<=10485760 and page_id%5<>3 and page_id%4 in (0,1) then 'accepted' else 'rejected' end as side, count(*) n from u group by 1""")
def arrival_validation(spark, d):
    schema = table(spark, d, "pages").schema
    root = shared_dir(spark, "arrivals")
    stream = _uploads(arrivals.table_stream(spark, f"{d}/pages.parquet", schema))
    arrivals.validate_arrivals(stream, f"{root}/accepted", f"{root}/rejected", f"{root}/checkpoint").awaitTermination()
    side = lambda s: spark.read.parquet(f"{root}/{s}").select(F.lit(s).alias("side"))
    return side("accepted").unionByName(side("rejected")).groupBy("side").agg(F.count("*").alias("n"))


@query("arrival_scores", "select event_id, round(least(value/500.0,1.0),6) as score from events")
def arrival_scores(spark, d):
    schema = table(spark, d, "events").schema
    root = shared_dir(spark, "scored")
    scorer = lambda s: s.select("event_id", F.round(F.least(F.col("value") / 500.0, F.lit(1.0)), 6).alias("score"))
    for _ in range(2):  # the second run finds nothing new
        arrivals.score_arrivals(arrivals.table_stream(spark, f"{d}/events.parquet", schema), scorer, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, score double").parquet(f"{root}/out")


@query("stored_scores", f"with {LONG} select technique, count(*) n from long where technique<>'T04' group by 1")
def stored_scores(spark, d):
    """Raw scores written per technique; the vector of the wrong length is skipped on reading."""
    path = shared_dir(spark, "scores")
    s = scored_long(spark, d).withColumns({"protocol": F.lit("standard"), "condition": F.lit("clean")})
    sinks.write_scores(s, path)
    return readers.read_stored_scores(spark, path, table(spark, d, "events")).groupBy("technique").agg(F.count("*").alias("n"))


@query("score_cache_missing", f"with {LONG} select technique, sample_id from long where sample_id%3=0")
def score_cache_missing(spark, d):
    wanted = scored_long(spark, d).select("technique", "sample_id", F.lit("m1").alias("manifest_id"), F.lit("v1").alias("model_version"), F.lit("clean").alias("condition"))
    cache = scored_long(spark, d).filter("sample_id % 3 <> 0").select(
        "technique", "sample_id", "score", F.lit("m1").alias("manifest_id"), F.lit("v1").alias("model_version"), F.lit("clean").alias("condition"))
    return evaluation.score_cache(cache, wanted)[1].select("technique", "sample_id")


@query("score_cache_lookup", f"""with {LONG}, c as (select *, case when sample_id%3<>0 and not (technique='T02' and sample_id%2=0) then 'hit' else 'miss' end as found from long)
select technique, found, count(*) n, round(sum(case when found='hit' then score end),6) as total from c group by 1,2""")
def score_cache_lookup(spark, d):
    """Two thirds were scored before, half of T02 by an earlier model; what is missing is merged and then found."""
    key = lambda df: df.select("technique", "sample_id", "score", F.lit("m1").alias("manifest_id"), F.lit("clean").alias("condition"), F.lit("v1").alias("model_version"))
    rows = key(scored_long(spark, d))
    cache = evaluation.ScoreCache(spark, shared_dir(spark, "cache"), buckets=partitions(spark))
    old = (F.col("technique") == "T02") & (F.col("sample_id") % 2 == 0)
    cache.merge(rows.filter("sample_id % 3 <> 0").withColumn("model_version", F.when(old, "v0").otherwise(F.lit("v1"))))
    cache.merge(rows.filter("sample_id % 3 = 1").filter(~old))            # nothing new
    hits, misses = cache.lookup(rows.drop("score"))
    both = hits.withColumn("found", F.lit("hit")).unionByName(misses.withColumn("found", F.lit("miss")), allowMissingColumns=True)
    return rounded(both.groupBy("technique", "found").agg(F.count("*").alias("n"), F.sum("score").alias("total")), "total")


@query("summary_table", f"""with {_RUNS}, {metrics_sql('runs', 'protocol, technique, condition')} select protocol, technique, condition, round(accuracy,6) accuracy, round(auc,6) auc, null as error, null::double as ms_per_image from m
 union all select 'ood','T05','clean',null,null,'no model',1.5""")
def summary_table(spark, d):
    m = rounded(metrics.evaluate(runs(spark, d), ["protocol", "technique", "condition"]), "accuracy", "auc").select("protocol", "technique", "condition", "accuracy", "auc")
    failed = spark.createDataFrame([("ood", "T05", "clean", "no model", 1.5)], "protocol string, technique string, condition string, error string, ms_per_image double")
    path = shared_dir(spark, "summary")
    union = sinks.union_results([m, failed])
    sinks.write_table(union, path)
    return spark.read.schema(union.schema).option("header", True).csv(path)


@query("generator_summary_table", f"""with {_RUNS}, gens as (select distinct technique t, condition c, generator g from runs where label=1),
pairs as (select t as technique, c as condition, g as generator, s.label, s.score from gens join runs s on s.technique=t and s.condition=c and (s.label=0 or s.generator=g)),
{metrics_sql('pairs', 'technique, condition, generator')} select technique, condition, 0 as seed, generator, round(accuracy,6) accuracy, round(auc,6) auc, n_samples, null::double as ms_per_image from m
 union all select 'T05','clean',0,'glide',null,0.5,10,1.5""")
def generator_summary_table(spark, d):
    m = rounded(metrics.evaluate_by_generator(runs(spark, d), ["technique", "condition"]), "accuracy", "auc").select(
        "technique", "condition", F.lit(0).alias("seed"), "generator", "accuracy", "auc", "n_samples")
    extra = spark.createDataFrame([("T05", "clean", 0, "glide", 0.5, 10, 1.5)], "technique string, condition string, seed int, generator string, auc double, n_samples bigint, ms_per_image double")
    path = shared_dir(spark, "by_generator")
    union = sinks.union_results([m, extra], sinks.GENERATOR_LEADING)
    sinks.write_table(union, path)
    return spark.read.schema(union.schema).option("header", True).csv(path)


@query("latest_result", f"with {LONG}, {metrics_sql('long', 'technique, generator')} select technique, generator, accuracy::double as accuracy from (select technique, generator, round(accuracy,6) accuracy from m where technique='T02')")
def latest_result(spark, d):
    root = shared_dir(spark, "results")
    m = rounded(metrics.classification_metrics(scored_long(spark, d), ["technique", "generator"]), "accuracy").select("technique", "generator", "accuracy")
    parts = m.repartition(partitions(spark), "technique", "generator")
    sinks.write_table(parts.withColumn("accuracy", F.lit(0.0)), f"{root}/1")
    sinks.write_table(parts, f"{root}/2")
    return readers.latest_result(spark, f"{root}/*", "technique string, generator string, accuracy double", "T02", by="path")


@query("run_log", """select count(distinct event_type) as n_results, '[' || string_agg('{"protocol":"ood","technique":"'||event_type||'","condition":"clean","error":"failed"}', ',' order by event_type) filter (event_type in ('error','purchase')) || ']' as failures
 from (select distinct event_type from events)""")
def run_log(spark, d):
    r = table(spark, d, "events").select(F.lit("ood").alias("protocol"), F.col("event_type").alias("technique"), F.lit("clean").alias("condition")).distinct().withColumn(
        "error", F.when(F.col("technique").isin("error", "purchase"), F.lit("failed")))
    return sinks.run_log(r).drop("timestamp")


@query("integrity_json", f"""with {ENTRIES} select '{{"n_total":'||count(*)||',"n_real":'||count(*) filter (label=0)||',"n_fake":'||count(*) filter (label=1)||'}}' as value from ent""")
def integrity_json(spark, d):
    from ..operators.integrity import integrity_report
    path = shared_dir(spark, "integrity")
    sinks.write_table(sinks.report_json(integrity_report(entries(spark, d)).select("n_total", "n_real", "n_fake")), path, "text")
    return spark.read.text(path)


@query("appended_rows", "select event_type, count(*) n from events group by 1")
def appended_rows(spark, d):
    """Two appends; the second holds only rows the first has not written."""
    path = shared_dir(spark, "append")
    e = table(spark, d, "events").select("event_id", "event_type")
    sinks.append_rows(e.filter("event_id % 2 = 0"), path)
    done = spark.read.schema(e.schema).parquet(path)
    sinks.append_rows(e.join(done.select("event_id"), "event_id", "left_anti"), path)
    return spark.read.schema(e.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("analysis_files", f"with {WIDE} select generator, count(*) n from wide group by 1")
def analysis_files(spark, d):
    path = shared_dir(spark, "analysis")
    counts = scored_wide(spark, d).groupBy("generator").agg(F.count("*").alias("n"))
    sinks.write_table(counts, path, "json")
    return spark.read.schema(counts.schema).json(path)
