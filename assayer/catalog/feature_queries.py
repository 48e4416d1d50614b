"""Benford, DCT, co-occurrence, masks, perturbations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..bindings import blocks, masks, table
from ..constants import AC_POSITIONS, BENFORD_BASES, BENFORD_QUALITIES
from ..operators import features, filters, summaries
from ..plans.evaluation import robustness_inputs
from .metric_queries import rounded
from .registry import BLOCKS, MASKS, query

_BASES = "(values (10),(20),(40),(60)) b(base)"
_DIGIT = "cast(greatest(1,least(base-1,floor(abs(v)/pow(base,floor(ln(abs(v))/ln(base)))))) as int)"


@query("benford_law", f"""with x as (select l_extendedprice as v from lineitem), n as (select base, {_DIGIT} as digit, count(*) n from x, {_BASES} where v<>0 group by all)
select base, d::int as digit, coalesce(n,0) as n, round(ln(1+1.0/d)/ln(base),6) as share from (select base, d from {_BASES}, range(1,60) t(d) where d<base) g
 left join n on n.base=g.base and n.digit=g.d""".replace("select base, d::int", "select g.base, g.d::int").replace("1.0/d)/ln(base),6)", "1.0/g.d)/ln(g.base),6)"))
def benford_law(spark, d):
    """How often each first digit occurs in the line items, beside its share under the law."""
    prices = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v"))
    seen = features.digit_counts(prices, [], "v", BENFORD_BASES)
    law = features.benford_law(spark).join(seen, ["base", "digit"], "left")
    return rounded(law.withColumn("n", F.coalesce("n", F.lit(0))), "share")


@query("first_digits", f"with x as (select o_orderkey, o_totalprice as v from orders) select o_orderkey, base, {_DIGIT} as digit from x, {_BASES}")
def first_digits(spark, d):
    from ..functions.benford import first_digit
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*[F.lit(b) for b in BENFORD_BASES])).alias("base"))
    return o.select("o_orderkey", "base", first_digit(F.col("o_totalprice"), F.col("base")).alias("digit"))


def _digits_sql(source: str, keys: str) -> str:
    """Full digit grid with observed shares p and expected shares q."""
    return f"""
dg as (select {keys}, base, {_DIGIT} as digit, count(*) c from {source}, {_BASES} where v<>0 group by all),
gr as (select distinct {keys}, base from {source}, {_BASES}),
tot as (select {keys}, base, sum(c) t from dg group by all),
full0 as (select gr.*, d::int as digit, ln(1+1.0/d)/ln(base) as q from gr, range(1,60) r(d) where d<base),
dist as (select f.*, coalesce(c,0) as n, case when t is null then 1.0/(base-1) else coalesce(c,0)/t end as p
  from full0 f left join dg using ({keys}, base, digit) left join tot using ({keys}, base))"""


_DIV = """cl as (select *, greatest(p,1e-12) pp, greatest(q,1e-12) qq from dist),
sm as (select {keys}, base, 0.5*sum(pp*log2(pp/(0.5*(pp+qq)))+qq*log2(qq/(0.5*(pp+qq)))) js, sum(sqrt(pp)*sqrt(qq)) bc from cl group by all)
select {keys}, base, round(js,6) as jensen_shannon, round(ln(greatest(bc,1e-12))/(-0.5),6) as renyi, round((bc-1)/(-0.5),6) as tsallis from sm"""


@query("digit_distribution_orders", "with x as (select o_orderpriority as k, o_totalprice as v from orders)," + _digits_sql("x", "k") +
       " select k, base, digit, n::bigint as n, round(p,6) as share from dist")
def digit_distribution_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(features.digit_distribution(o, ["k"], "v", BENFORD_BASES), "share")


@query("divergences_orders", "with x as (select o_orderpriority as k, o_totalprice as v from orders)," + _digits_sql("x", "k") + "," + _DIV.format(keys="k"))
def divergences_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(features.benford_divergences(o, ["k"], "v"), "jensen_shannon", "renyi", "tsallis")


@query("divergences_line_items", "with x as (select l_returnflag as k, l_extendedprice as v from lineitem)," + _digits_sql("x", "k") + "," + _DIV.format(keys="k"))
def divergences_line_items(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"))
    return rounded(features.benford_divergences(o, ["k"], "v"), "jensen_shannon", "renyi", "tsallis")


# Luminance table in raster order, as SQL.
_LUMA = ("[16,11,10,16,24,40,51,61,12,12,14,19,26,58,60,55,14,13,16,24,40,57,69,56,14,17,22,29,51,87,80,62,"
         "18,22,37,56,68,109,103,77,24,35,55,64,81,104,113,92,49,64,78,87,103,121,120,101,72,92,95,98,112,100,103,99]")
_DCT = BLOCKS + """,
one as (select k, n, case when k=0 then sqrt(1.0/8) else sqrt(2.0/8)*cos(pi()*(2*n+1)*k/16.0) end as c from range(0,8) a(k), range(0,8) b(n)),
basis as (select (u.k*8+v.k)::int as pos, (u.n*8+v.n)::int as px, u.c*v.c as w from one u, one v),
pix as (select sample, block, unnest(range(0,64))::int as px, unnest(pixels)-128 as x from blk),
dct as (select sample, block, pos, round(sum(x*w),9) as coef from pix join basis using (px) group by all)"""
_QT = f"greatest(1,least(255,(({_LUMA})[pos+1]*case when quality<50 then 5000//quality else 200-2*quality end+50)//100))"


@query("quantised_dct", f"with {_DCT} select block, pos, cast(round_even(coef/{_QT.replace('quality', '90')},0) as int) as v from dct")
def quantised_dct(spark, d):
    return features.quantised_dct(blocks(spark, d), 90).select("block", F.posexplode("quantised").alias("pos", "v"))


_AC = "[1,8,16,9,2,3,10,17,24]"
_FEATS = _DCT + f""",
qs as (select unnest([80,85,90,95,100]) as quality),
x as (select sample, quality, list_position({_AC},pos) as ac, round_even(coef/{_QT},0) as v from dct, qs where list_contains({_AC},pos)),"""


@query("benford_block_features", f"with {_FEATS}" + _digits_sql("x", "sample, quality, ac") + "," + _DIV.format(keys="sample, quality, ac"))
def benford_block_features(spark, d):
    return rounded(features.benford_features(blocks(spark, d)), "jensen_shannon", "renyi", "tsallis")


@query("benford_feature_vectors", f"with {_FEATS}" + _digits_sql("x", "sample, quality, ac") + ", ff as (" + _DIV.format(keys="sample, quality, ac").replace("cl as", "with cl as", 1) +
       """), pos as (select sample, ((list_position([80,85,90,95,100],quality)-1)*9+ac-1)*4+list_position([10,20,40,60],base)-1 as g, jensen_shannon, renyi, tsallis from ff)
select sample, (g*3+i)::int as position, case i when 0 then jensen_shannon when 1 then renyi else tsallis end as value from pos, range(0,3) r(i)""")
def benford_feature_vectors(spark, d):
    v = features.feature_vectors(blocks(spark, d))
    return v.select("sample", F.posexplode("features").alias("position", "value")).withColumn("value", F.round("value", 6))


@query("named_features", f"with {_FEATS}" + _digits_sql("x", "sample, quality, ac") + ", ff as (" + _DIV.format(keys="sample, quality, ac").replace("cl as", "with cl as", 1) +
       """) select name, round(max(value),6) as highest from (select 'qf'||quality||'_ac'||ac||'_b'||base||'_'||d as name, value from ff,
 lateral (values ('jensen_shannon',jensen_shannon),('renyi',renyi),('tsallis',tsallis)) v(d,value)) group by 1""")
def named_features(spark, d):
    v = features.feature_vectors(blocks(spark, d))
    flat = v.select(F.posexplode("features").alias("position", "value"))
    m = flat.groupBy("position").agg(F.max("value").alias("highest"))
    return rounded(m.join(features.feature_names(spark), "position").select("name", "highest"), "highest")


_PAIRS = BLOCKS + """, grid as (select y, x from range(0,8) a(y), range(0,8) b(x)),
prs as (select sample, pixels[y*8+x+1]::int as i, pixels[(y+{dy})*8+x+{dx}+1]::int as j, count(*) n from blk, grid where y+{dy}<8 and x+{dx}<8 group by all)"""


@query("cooccurrence_horizontal", f"with {_PAIRS.format(dy=0, dx=1)} select sample, i, j, n, round(n/sum(n) over (partition by sample),6) as share from prs")
def cooccurrence_horizontal(spark, d):
    pairs = features.plane_pairs(blocks(spark, d), ["sample"], "pixels", 8, 8)
    return rounded(features.cooccurrence(pairs, ["sample"]), "share")


@query("channel_cooccurrence", f"with {_PAIRS.format(dy=1, dx=0)} select sample, i, j, n, round(n/sum(n) over (partition by sample)*10000,6) as share from prs")
def channel_cooccurrence(spark, d):
    """One row per pixel, vertical neighbour, at the scale of the model input."""
    b = blocks(spark, d).select("sample", "block", F.posexplode("pixels").alias("p", "v"))
    px = b.select("sample", "block", F.floor(F.col("p") / 8).cast("int").alias("y"), F.pmod("p", F.lit(8)).alias("x"), F.col("v").cast("int").alias("value"))
    pairs = features.pixel_pairs(px, ["sample", "block"], dy=1, dx=0).groupBy("sample", "i", "j").agg(F.sum("n").alias("n"))
    return rounded(features.channel_cooccurrence(pairs, ["sample"]), "share")


@query("channel_tensor", BLOCKS.replace("\nblk", "with blk", 1) + """, chn as (select block//3 as sample, (block%3)::int as channel, pixels from blk),
prs as (select sample, channel, pixels[y*8+x+1]::int as i, pixels[y*8+x+2]::int as j, count(*) n from chn, range(0,8) a(y), range(0,7) b(x) group by all)
select sample, channel*65536+i*256+j as position, round(n/sum(n) over (partition by sample, channel)*10000,6) as value from prs""")
def channel_tensor(spark, d):
    """Three embeddings as the channels of one image: a sparse vector of 3 x 256 x 256 at the scale of the model input."""
    planes = blocks(spark, d).select(F.floor(F.col("block") / 3).alias("sample"), F.pmod("block", F.lit(3)).cast("int").alias("channel"), "pixels")
    pairs = features.plane_pairs(planes, ["sample", "channel"], "pixels", 8, 8)
    vector = features.channel_tensor(pairs)
    return rounded(vector.select("sample", F.explode(F.arrays_zip("positions", "shares")).alias("e")).select(
        "sample", F.col("e.positions").alias("position"), F.col("e.shares").alias("value")), "value")


@query("class_masks", f"""with {MASKS}, smp as (select distinct sample from mask), g as (select sample, k::int as klass, p::bigint as pixel from smp, range(0,2) a(k), range(0,64) b(p)),
o as (select distinct sample, klass, pixel::bigint as pixel from mask where value>0.5)
select g.sample, g.klass, g.pixel, case when o.sample is null then 0 else 255 end as level from g left join o using (sample, klass, pixel)""")
def class_masks(spark, d):
    m = masks(spark, d)
    return features.class_masks(m, 64)


# What the detector is less sure of than 5 is no instance; with nothing at 3 or more it returned nothing.
_LOG = MASKS + """, kept as (select * from mask where confidence>=5), onp as (select sample, klass, pixel, max((value>0.5)::int) as on_ from kept group by all),
inst as (select sample, count(distinct instance) n_instances, count(distinct instance) filter (klass=0) n_object, count(distinct instance) filter (klass=1) n_shadow from kept group by 1),
area as (select sample, sum(on_) filter (klass=0)/64 as o, sum(on_) filter (klass=1)/64 as s from onp group by 1),
smp as (select vec_id//4 as sample, max(label)<3 as null_detection from embeddings group by 1),
lg as (select sample, coalesce(n_instances,0) n_instances, coalesce(n_object,0) n_object, coalesce(n_shadow,0) n_shadow, coalesce(o,0) as area_object, coalesce(s,0) as area_shadow, null_detection
  from smp left join inst using (sample) left join area using (sample))"""


def _log(spark, d):
    m = masks(spark, d)
    smp = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("sample")).agg((F.max("label") < 3).alias("null_detection"))
    return summaries.extraction_log(m.filter("confidence >= 5"), samples=smp)


@query("extraction_log", f"with {_LOG} select sample, n_instances, n_object, n_shadow, round(area_object,6) area_object, round(area_shadow,6) area_shadow, null_detection from lg")
def extraction_log(spark, d):
    return rounded(_log(spark, d), "area_object", "area_shadow")


@query("extraction_summary", f"""with {_LOG} select count(*) n_samples, count(*) filter (n_instances=0) n_without, count(*) filter (null_detection) n_null_detection,
 sum(n_object)::bigint n_object, sum(n_shadow)::bigint n_shadow, round(count(*) filter (n_instances=0)/count(*),6) as share_without from lg""")
def extraction_summary(spark, d):
    return rounded(summaries.extraction_summary(_log(spark, d)), "share_without")


@query("class_bitmaps", f"""with {MASKS}, o as (select sample, klass, pixel from mask where value>0.5 group by all), smp as (select distinct sample from mask)
select s.sample, k::int as klass, count(o.pixel) as area, coalesce(sum(case when pixel<63 then 1::hugeint<<pixel::int end) - case when bool_or(pixel=63) then 9223372036854775808::hugeint else 0 end,
 case when bool_or(pixel=63) then -9223372036854775808::hugeint else 0 end)::bigint as word
from smp s cross join range(0,2) r(k) left join o on o.sample=s.sample and o.klass=k group by 1,2""")
def class_bitmaps(spark, d):
    """One row for each sample and class; masks here have one word of 64 pixels."""
    maps = features.class_bitmaps(masks(spark, d))
    return maps.select("sample", "klass", "area", F.coalesce(F.try_element_at("words", F.lit(0).cast("bigint")), F.lit(0).cast("bigint")).alias("word"))


_TWO_PI = "6.283185307179586"
_COND = "(values ('clean','clean',0.0),('jpeg_q50','jpeg',50.0),('jpeg_q70','jpeg',70.0),('jpeg_q85','jpeg',85.0),('noise_sigma1','noise',1.0),('noise_sigma3','noise',3.0),('noise_sigma5','noise',5.0),('resize_50','resize',0.5),('resize_70','resize',0.7),('resize_85','resize',0.85)) c(condition,kind,level)"


# A perturbed value, of the rows that ``perturbed_signals`` calls g.
_PERTURBED = f"""case kind when 'clean' then pixels[k+1]
  when 'noise' then greatest(0.0,least(255.0,round_even(pixels[k+1]+level*(sqrt(-2*ln((('0x'||substr(h,1,8))::bigint+0.5)/4294967296.0))*cos({_TWO_PI}*((('0x'||substr(h,9,8))::bigint+0.5)/4294967296.0))),0)))
  when 'jpeg' then least(255.0,round_even(pixels[k+1]/greatest(1.0,round_even((100-level)/5.0,0)),0)*greatest(1.0,round_even((100-level)/5.0,0)))
  else pixels[floor(k/level)::int+1] end"""


@query("perturbed_signals", BLOCKS.replace("\nblk", "with blk", 1) + f""", cnd as (select condition, kind, level::double as level from {_COND}),
g as (select block, condition, kind, level, k, pixels, md5('42|'||block||'|'||k) as h from blk, cnd, range(0,64) r(k) where kind<>'resize' or k<floor(64*level)),
v as (select block, condition, {_PERTURBED} as x from g)
select block as sample_id, condition, block||'__'||condition as output_name, count(*) n_values, sum(x)::double as total from v group by all""")
def perturbed_signals(spark, d):
    b = blocks(spark, d).select(F.col("block").alias("sample_id"), "pixels")
    p = robustness_inputs(b)
    return p.select("sample_id", "condition", "output_name", F.size("pixels").cast("bigint").alias("n_values"),
                    F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("scalar_predictor_masks", f"""with {MASKS}, s as (select instance, klass as label, sum((value>0.5)::int) as score from mask group by all), r as (select *, rank() over (order by score)+(count(*) over (partition by score)-1)/2.0 mid from s)
select count(*) n_samples, round((sum(mid) filter (label=1)-count(*) filter (label=1)*(count(*) filter (label=1)+1)/2.0)/(count(*) filter (label=1)*count(*) filter (label=0)),6) as auc,
 max(score)::double as max, count(*) filter (score>32) n_above, median(score)::double as median from r""")
def scalar_predictor_masks(spark, d):
    m = masks(spark, d).groupBy("instance", F.col("klass").alias("label")).agg(F.sum((F.col("value") > 0.5).cast("int")).alias("score"))
    return rounded(summaries.scalar_summary(m, "score", 32), "auc")
