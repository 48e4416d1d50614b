"""Manifests: scan, checks, splits, samples, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import entries, table
from ..constants import BENCHMARK_GENERATORS, SPLIT_PERCENT, TRAINING_GENERATORS
from ..functions import paths
from ..operators import filters, integrity, splits
from ..plans.corpus import prepare, split_for_protocol
from ..session import shared_dir
from ..sources import readers, sinks
from .registry import ALLOCATION, ENTRIES, FAMILY, FUSION, OOD, SPLITS, query


@query("corpus_scan", """with e as (select case when no<=4 then 0 else 1 end as label, case when no<=4 then 'real' else source end generator, source, text
 from (select *, cast(regexp_extract(source,'([0-9]+)',1) as int) no from documents))
select label, generator, source, count(*) n_files, sum(octet_length(encode(text))+1)::bigint n_bytes from e group by 1,2,3""")
def corpus_scan(spark, d):
    """Documents written as one file each under real/ and fake/, then scanned without reading bytes."""
    root = shared_dir(spark, "corpus")
    e = table(spark, d, "documents").select(
        F.when(F.regexp_extract("source", "([0-9]+)", 1).cast("int") <= 4, F.lit("real")).otherwise(F.lit("fake")).alias("top"),
        "source", "text", "doc_id")
    sinks.write_files(e, root, ["top", "source"], "text", "doc_id")
    return readers.scan_corpus(spark, root).groupBy("label", "generator", "source").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


@query("entry_columns", f"with {ENTRIES} select path, label, generator from ent")
def entry_columns(spark, d):
    return readers.entry_columns(entries(spark, d))


@query("manifest_roundtrip", f"with {SPLITS} select path, label, generator, split from splits where split='test'")
def manifest_roundtrip(spark, d):
    path = shared_dir(spark, "manifest")
    sinks.write_manifest(splits.assign_splits(entries(spark, d)), path)
    return readers.read_manifest(spark, path, "test", "parquet").select("path", "label", "generator", "split")


@query("manifest_csv_roundtrip", f"with {SPLITS} select path, label, generator, split from splits where split='val'")
def manifest_csv_roundtrip(spark, d):
    path = shared_dir(spark, "manifest_csv")
    sinks.write_manifest(splits.assign_splits(entries(spark, d)), path, "csv")
    return readers.read_manifest(spark, path, "val")


@query("work_list", f"""with {SPLITS} select sample_id, label, generator, path as origin, split as division,
 case label when 0 then 'real' else 'gen' end as class_name, sample_id||'.png' as name from splits where split='test' order by path limit 100""")
def work_list(spark, d):
    return readers.work_list(splits.assign_splits(entries(spark, d)), "test", limit=100)


@query("name_collisions", """with w as (select case when cast(regexp_extract(source,'([0-9]+)',1) as int)<=4 then 'real' else 'gen' end class_name,
 (doc_id%97)||'.png' as name, source||'/'||(doc_id%97)||'.txt' as origin from documents)
select 'all' as division, class_name, name, count(*) n, min(origin) as first, max(origin) as last from w group by 2,3 having count(*)>1""")
def name_collisions(spark, d):
    e = entries(spark, d).withColumns({
        "path": F.concat(F.col("source"), F.lit("/"), F.pmod("sample_id", F.lit(97)).cast("string"), F.lit(".txt")),
        "split": F.lit(None).cast("string")})
    return readers.name_collisions(readers.work_list(e))


@query("generator_filter", f"with {ENTRIES} select generator, count(*) n from ent where label=0 or generator='latent_diffusion' group by 1")
def generator_filter(spark, d):
    return integrity.counts_by(filters.filter_generators(entries(spark, d), TRAINING_GENERATORS), "generator")


@query("stratified_split", f"with {SPLITS} select sample_id, generator, split from splits")
def stratified_split(spark, d):
    return splits.assign_splits(entries(spark, d)).select("sample_id", "generator", "split")


@query("split_allocation", """with strata as (select l_suppkey as stratum, count(*) n from lineitem group by 1 union all
 select 1000000000+c_custkey, c_custkey%12 from customer)""" + ", " + ALLOCATION +
       " select stratum, n, c_train as train, c_val as val, c_test as test from alloc")
def split_allocation(spark, d):
    """Largest-remainder counts for strata of many sizes, small ones included."""
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("stratum")).agg(F.count("*").alias("n"))
    small = table(spark, d, "customer").select((F.col("c_custkey") + 1000000000).alias("stratum"), F.pmod("c_custkey", F.lit(12)).alias("n"))
    return sizes.unionByName(small).select("stratum", "n", *[c.alias(s) for s, c in splits.allocation(F.col("n"), SPLIT_PERCENT).items()])


@query("ood_split", f"with {OOD} select sample_id, split from ood")
def ood_split(spark, d):
    return splits.ood_split(splits.assign_splits(entries(spark, d))).select("sample_id", "split")


@query("ood_split_by_family", f"with {FAMILY} select sample_id, split from fam where split<>'excluded'")
def ood_split_by_family(spark, d):
    return filters.drop_excluded(splits.ood_split_by_family(splits.assign_splits(entries(spark, d)))).select("sample_id", "split")


@query("fusion_calibration_split", f"with {FUSION} select sample_id, label, split from fus")
def fusion_calibration_split(spark, d):
    return split_for_protocol(entries(spark, d), "ood").select("sample_id", "label", "split")


@query("split_counts", f"with {FUSION} select split, count(*) n from fus group by 1")
def split_counts(spark, d):
    return splits.split_counts(split_for_protocol(entries(spark, d), "ood"))


@query("split_disjointness", f"with {FUSION} select count(*) as n_shared from (select path from fus group by path having count(distinct split) > 1)")
def split_disjointness(spark, d):
    """Paths that two splits share: must be none."""
    m = split_for_protocol(entries(spark, d), "ood")
    return m.groupBy("path").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_shared"))


@query("prepared_manifest", f"with {FUSION} select split, label, count(*) n from fus group by 1,2")
def prepared_manifest(spark, d):
    path, report = shared_dir(spark, "prepared"), shared_dir(spark, "integrity")
    prepare(entries(spark, d), path, report, "ood")
    return readers.read_manifest(spark, path, fmt="parquet").groupBy("split", "label").agg(F.count("*").alias("n"))


@query("balanced_sample", f"""with {ENTRIES}, r as (select sample_id, label, row_number() over (partition by label order by md5('42|'||sample_id), sample_id) rk from ent)
select sample_id, label from r where rk<=100""")
def balanced_sample(spark, d):
    return splits.balanced_sample(entries(spark, d), 200).select("sample_id", "label")


@query("exact_sample", f"with {ENTRIES} select sample_id, label from ent order by md5('42|'||sample_id), sample_id limit 50")
def exact_sample(spark, d):
    return splits.exact_sample(entries(spark, d), 50).select("sample_id", "label")


@query("stratified_folds", f"""with {ENTRIES}, r as (select sample_id, label, row_number() over (partition by label order by md5('42|'||sample_id), sample_id) rk,
 count(*) over (partition by label) n from ent)
select sample_id, label, cast(rk>n*1//5 as int)+cast(rk>n*2//5 as int)+cast(rk>n*3//5 as int)+cast(rk>n*4//5 as int) as fold from r""")
def stratified_folds(spark, d):
    return splits.stratified_folds(entries(spark, d)).select("sample_id", "label", "fold")


@query("first_per_generator", f"""with {ENTRIES}, r as (select path, generator, row_number() over (partition by generator order by path) rk from ent where label=1)
select path, generator, generator||'_'||lpad((rk-1)::varchar,5,'0')||'.png' as new_name from r where rk<=10""")
def first_per_generator(spark, d):
    e = entries(spark, d).filter("label = 1").select("path", "generator")
    return splits.first_per_group(e, "generator", "path", 10, suffix=paths.suffix(F.col("path")))


_LISTED = """l as (select (o_orderkey*7)%5000 as doc_id, min(o_orderkey) as pos from orders group by 1),
k as (select doc_id, pos from l where doc_id in (select doc_id from documents) order by pos limit 300)"""


def _listed(spark, d, index):
    listing = table(spark, d, "orders").groupBy(F.pmod(F.col("o_orderkey") * 7, F.lit(5000)).alias("doc_id")).agg(F.min("o_orderkey").alias("pos"))
    return splits.list_ordered(listing, table(spark, d, "documents"), "doc_id", "pos", 300, index).select("doc_id", "item_index")


@query("listed_selection_present_index", f"with {_LISTED} select doc_id, row_number() over (order by pos)-1 as item_index from k")
def listed_selection_present_index(spark, d):
    return _listed(spark, d, "present")


@query("listed_selection_list_index", f"with {_LISTED} select doc_id, pos as item_index from k")
def listed_selection_list_index(spark, d):
    return _listed(spark, d, "list")


def _resample_sql(size: int) -> str:
    draw = "embedding[1+('0x'||substr(md5('42|'||vec_id||'|'||k),1,8))::bigint%64]"
    value = draw if size < 64 else f"case when pos<=64 then embedding[pos] else {draw} end"
    k = "pos" if size < 64 else "pos-64"
    return (f"select vec_id, pos-1 as pos, round({value}::double,6) as item from (select *, {k} as k from embeddings, range(1,{size + 1}) t(pos))")


def _resampled(spark, d, size):
    e = splits.fixed_size_resample(table(spark, d, "embeddings"), "embedding", size, id_col="vec_id")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("item"))


@query("fixed_size_resample_long", _resample_sql(20))
def fixed_size_resample_long(spark, d):
    return _resampled(spark, d, 20)


@query("fixed_size_resample_short", _resample_sql(100))
def fixed_size_resample_short(spark, d):
    return _resampled(spark, d, 100)


@query("integrity_report", f"""with {ENTRIES} select count(*) n_total, count(*) filter (label=0) n_real, count(*) filter (label=1) n_fake,
 0::bigint n_corrupted, count(*) filter (size<>256) n_wrong_size, (select count(*) from (select content_hash from ent group by 1 having count(*)>1)) n_duplicate_groups,
 false as ok from ent""")
def integrity_report(spark, d):
    e = entries(spark, d)
    return integrity.integrity_report(e, "size", "size", 256)


@query("integrity_report_signatures", """with e as (select page_id, html, url, case when starts_with(html,'<!DOCTYPE html><html><head>') then 'doctype' else 'other' end as kind from pages),
x as (select *, case when html is null or html='' or page_id%5=0 then true else false end as bad from e)
select count(*) n_total, count(*) filter (length(url)%2=0) n_real, count(*) filter (length(url)%2=1) n_fake, count(*) filter (bad) n_corrupted, count(*) filter (octet_length(encode(html))<>256) n_wrong_size,
 (select count(*) from (select html from pages where html is not null and page_id%5<>0 group by 1 having count(*)>1))
 + (select count(*) from (select html from pages where html is not null and page_id%5=0 group by 1 having count(*)>1)) n_duplicate_groups,
 count(*) filter (bad)=0 and count(*) filter (octet_length(encode(html))<>256)=0 as ok from x""")
def integrity_report_signatures(spark, d):
    """Pages as files: four in five follow the signature of an image, the others begin as the text that they are and are corrupt."""
    signature = F.element_at(F.array(F.lit("89504E470D0A1A0A"), F.lit("FFD8FFE0"), F.lit("474946383961")), F.lit(1))
    body = F.col("html").cast("binary")
    content = F.when(F.col("page_id") % 5 == 0, body).otherwise(F.concat(F.unhex(signature), body))
    e = table(spark, d, "pages").select(
        F.col("page_id").alias("sample_id"), F.pmod(F.length("url"), F.lit(2)).alias("label"), F.octet_length("html").alias("size"), content.alias("content"))
    e = e.withColumns({"content_hash": F.when(F.octet_length("content") > 0, F.md5("content")), "magic": F.hex(F.substring("content", 1, 12))})
    return integrity.integrity_report(e, "size", "size", 256)


@query("integrity_report_no_size", f"""with {ENTRIES} select count(*) n_total, 0::bigint n_wrong_size,
 (select count(*) from (select content_hash from ent group by 1 having count(*)>1)) n_duplicate_groups from ent""")
def integrity_report_no_size(spark, d):
    return integrity.integrity_report(entries(spark, d), "size", "size", 0).select("n_total", "n_wrong_size", "n_duplicate_groups")


@query("wrong_size_files", f"with {ENTRIES} select path, 'wrong_size' as problem from ent where size>20000 or size<100")
def wrong_size_files(spark, d):
    e = entries(spark, d)
    bad = (F.col("size") > 20000) | (F.col("size") < 100)
    return integrity.problem_files(e, F.col("content_hash").isNull(), bad).select("path", "problem")


@query("duplicate_groups", f"with {ENTRIES} select content_hash, count(*) n_copies, min(sample_id) first_id from ent group by 1 having count(*)>1")
def duplicate_groups(spark, d):
    return integrity.duplicate_groups(entries(spark, d))


@query("duplicate_members", f"""with {ENTRIES}, g as (select content_hash, count(*) n_copies, min(sample_id) first_id from ent group by 1 having count(*)>1)
select sample_id, content_hash, n_copies, first_id from ent join g using (content_hash)""")
def duplicate_members(spark, d):
    return integrity.duplicate_members(entries(spark, d))


@query("content_leakage", f"""with {SPLITS} select content_hash, array_to_string(list_sort(list(distinct split)),',') as splits, count(*) n_rows
 from splits group by 1 having count(distinct split)>1""")
def content_leakage(spark, d):
    return integrity.leakage(splits.assign_splits(entries(spark, d)))


@query("counts_by_generator", f"with {ENTRIES} select generator, count(*) n from ent group by 1")
def counts_by_generator(spark, d):
    return integrity.counts_by(entries(spark, d), "generator")


@query("unexpected_generators", f"with {ENTRIES} select generator, count(*) n from ent where generator='unlisted_model' group by 1")
def unexpected_generators(spark, d):
    return integrity.unexpected_generators(entries(spark, d))


@query("generator_imbalance", """with e as (select p_type as generator, count(*) n from part group by 1)
select min(n) smallest, max(n) largest, round(max(n)/min(n),6) as spread, max(n)/min(n)>1.5 as imbalanced from e""")
def generator_imbalance(spark, d):
    p = table(spark, d, "part")
    return integrity.imbalance(p.select(F.col("p_type").alias("generator"))).withColumn("spread", F.round("spread", 6))


@query("class_balance", f"""with {ENTRIES} select count(*) filter (label=1) n_fake, count(*) filter (label=0) n_real,
 round(count(*) filter (label=1)/count(*) filter (label=0),6) as fake_to_real, count(*) filter (label=1)/count(*) filter (label=0)>1.5 as warn,
 abs(count(*) filter (label=1)-count(*) filter (label=0))<=greatest(1,0.01*count(*) filter (label=0)) as balanced from ent""")
def class_balance(spark, d):
    return integrity.class_balance(entries(spark, d)).withColumn("fake_to_real", F.round("fake_to_real", 6))


@query("most_common_sizes", "select n_chars as size, count(*) n from documents group by 1 order by n desc, size limit 8")
def most_common_sizes(spark, d):
    return integrity.most_common(entries(spark, d), "size")


@query("corpus_info", f"""with {ENTRIES} select count(*) filter (label=1) total_fake, count(*) filter (label=0) total_real,
 count(distinct generator) filter (label=1) n_generators, count(distinct source) filter (label=0) n_sources,
 abs(count(*) filter (label=1)-count(*) filter (label=0))<=greatest(1,0.01*count(*) filter (label=0)) as balanced from ent""")
def corpus_info(spark, d):
    path = shared_dir(spark, "corpus_info")
    info = sinks.corpus_info(entries(spark, d))
    sinks.write_table(info, path, "json")
    return spark.read.schema(info.schema).json(path)


@query("corpus_counts", f"with {ENTRIES} select label, generator, source, count(*) n from ent group by 1, 2, 3")
def corpus_counts(spark, d):
    path = shared_dir(spark, "corpus_counts")
    sinks.write_table(sinks.corpus_counts(entries(spark, d)), path, "json")
    return spark.read.schema("label int, generator string, source string, n bigint").json(path)


@query("archive_members", f"""with {ENTRIES}, m as (select 'synthbuster/'||replace(generator,'adobe_','')||'/'||sample_id||case when sample_id%5=0 then '.txt' else '.PNG' end as member, sample_id from ent where sample_id%2=0
 union all select replace(replace(generator,'_','-'),'v6-1','v6.1')||'/'||sample_id||'.jpg', sample_id from ent where sample_id%2=1),
f as (select *, case when split_part(member,'/',1)='synthbuster' then split_part(member,'/',2) else split_part(member,'/',1) end as folder from m where not member like '%.txt')
select member, case folder when 'firefly' then 'adobe_firefly' when 'midjourney-v6.1' then 'midjourney_v6_1' when 'midjourney-v5' then 'midjourney_v5'
  else replace(folder,'-','_') end as generator from f where folder in ('glide','stable-diffusion-1-3','stable-diffusion-1-4','stable-diffusion-2','stable-diffusion-xl','dalle2','dalle3','firefly','midjourney-v5','flux','gigagan','midjourney-v6.1','stable-diffusion-3')""")
def archive_members(spark, d):
    e, i = entries(spark, d), F.col("sample_id")
    folder1 = F.concat(F.lit("synthbuster/"), F.regexp_replace("generator", "adobe_", ""))
    folder2 = F.regexp_replace(F.regexp_replace("generator", "_", "-"), "v6-1", "v6.1")
    ext = F.when(F.pmod(i, F.lit(5)) == 0, F.lit(".txt")).otherwise(F.lit(".PNG"))
    even = F.pmod(i, F.lit(2)) == 0
    member = F.when(even, F.concat(folder1, F.lit("/"), i.cast("string"), ext)).otherwise(
        F.concat(folder2, F.lit("/"), i.cast("string"), F.lit(".jpg")))
    return filters.archive_members(e.select(member.alias("member")))


@query("normalised_paths", f"""with {ENTRIES} select sample_id, case when sample_id%2=0 then '/mnt/'||case when sample_id%3=0 then 'c' else 'd' end||'/data/'||path else '/data/'||path end as origin,
 sample_id::varchar as stem, '.png' as suffix from ent""")
def normalised_paths(spark, d):
    i = F.col("sample_id")
    drive = F.when(F.pmod(i, F.lit(3)) == 0, F.lit("C:")).otherwise(F.lit("D:"))
    raw = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(drive, F.lit("\\data\\"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))).otherwise(
        F.concat(F.lit(" /data/"), F.col("path"), F.lit(" ")))
    e = entries(spark, d).select("sample_id", paths.posix_path(raw).alias("origin"))
    return e.select("*", paths.stem(F.col("origin")).alias("stem"), paths.suffix(F.col("origin")).alias("suffix"))


@query("mask_paths", f"""with {ENTRIES} select sample_id, case label when 0 then 'real' else 'gen' end as class_name,
 '/m/Set_shadow/test/'||case label when 0 then 'real' else 'gen' end||'/'||sample_id||'.jpg' as shadow_path,
 '/m/Set_object/test/'||case label when 0 then 'real' else 'gen' end||'/'||sample_id||'.jpg' as object_path from ent""")
def mask_paths(spark, d):
    klass = F.when(F.col("label") == 0, F.lit("real")).otherwise(F.lit("gen"))
    p = F.concat(F.lit("..\\dataset\\Set\\test\\"), klass, F.lit("\\"), F.col("sample_id").cast("string"), F.lit(".jpg"))
    e = entries(spark, d).select("sample_id", p.alias("p"))
    return e.select("sample_id", paths.segment(F.col("p"), -2).alias("class_name"), *paths.mask_paths(F.col("p"), "/m"))


@query("difficulty_subsets", """with un as (select doc_id from labels where quality=0), mis as (select doc_id from labels where toxic=1)
select 'easy' as subset, doc_id from documents where doc_id not in (select doc_id from un) and doc_id not in (select doc_id from mis)
union all select 'unconfident', doc_id from un union all select 'misclassified', doc_id from mis
union all select 'prequalified', doc_id from un union all select 'prequalified', doc_id from mis""")
def difficulty_subsets(spark, d):
    lab = table(spark, d, "labels")
    return splits.difficulty_subsets(table(spark, d, "documents"), lab.filter("quality = 0"), lab.filter("toxic = 1"), "doc_id")


@query("hard_item_union", "select doc_id from labels where quality=0 union select doc_id from labels where toxic=1")
def hard_item_union(spark, d):
    lab = table(spark, d, "labels")
    return lab.filter("quality = 0").select("doc_id").union(lab.filter("toxic = 1").select("doc_id")).distinct()
