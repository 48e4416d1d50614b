"""Query registry and the shared SQL of the table bindings."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and, where there is one, its SQL."""
    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


WIDE = """
wide0 as (select event_id as sample_id,
  case when event_type in ('view','click') then 'real' else event_type end as generator,
  case when event_type in ('view','click') then 0 else 1 end as label,
  least(value/500.0, 1.0) as t01, (user_id % 97)/96.0 as t02,
  cast(regexp_extract(props,'([0-9]+)',1) as double)/100.0 as t03,
  case when user_id % 5 <> 0 then (event_id % 89)/88.0 end as t04 from events),
wide as (select *, (t01+coalesce(t02,0.0)+coalesce(t03,0.0)+coalesce(t04,0.0))
  /(1+cast(t02 is not null as int)+cast(t03 is not null as int)+cast(t04 is not null as int)) as t05 from wide0)"""

LONG = WIDE + """,
long as (
  select sample_id, label, generator, 'T01' as technique, t01 as score from wide where t01 is not null union all
  select sample_id, label, generator, 'T02', t02 from wide where t02 is not null union all
  select sample_id, label, generator, 'T03', t03 from wide where t03 is not null union all
  select sample_id, label, generator, 'T04', t04 from wide where t04 is not null)"""

ALL = LONG + """,
allt as (select * from long union all
  select sample_id, label, generator, 'T05', t05 from wide where t05 is not null)"""

BIG = """
big0 as (select cast(l_returnflag='R' as int) as label,
  case when l_returnflag='R' then l_linestatus else 'real' end as generator,
  l_discount as d, l_extendedprice/100000.0 as p from lineitem),
big as (select label, generator, 'discount' as technique, d as score from big0 union all
  select label, generator, 'price', p from big0)"""

_NAMES = ("latent_diffusion", "glide", "stable_diffusion_1_3", "stable_diffusion_1_4", "stable_diffusion_2",
          "stable_diffusion_xl", "stable_diffusion_3", "flux", "dalle2", "dalle3", "adobe_firefly",
          "gigagan", "midjourney_v5", "midjourney_v6_1", "unlisted_model")
NAME_LIST = "[" + ",".join(f"'{n}'" for n in _NAMES) + "]"

ENTRIES = f"""
ent0 as (select *, cast(regexp_extract(source,'([0-9]+)',1) as int) as no from documents),
ent as (select doc_id as sample_id,
  case when no<=4 then 'real' else 'fake' end||'/'||source||'/'||doc_id||'.png' as path,
  case when no<=4 then 0 else 1 end as label,
  case when no<=4 then 'real' else ({NAME_LIST})[no-4] end as generator,
  source, md5(text) as content_hash, n_chars as size from ent0)"""

COMPONENTS = WIDE + """,
cbase as (select 'event_'||sample_id as name,
  case when sample_id%10<7 then 'train' when sample_id%10=7 then 'val' else 'test' end as split, * from wide),
cpf as (select name, split, label, (sample_id%101)/100.0 as score from cbase where sample_id%3<>0),
cls as (select name, split, label, t02 as score from cbase where sample_id%4<>0),
cos as (select name, split, label, t01 as score from cbase where sample_id%5<>0),
ctable as (select coalesce(cpf.name, cls.name, cos.name) as name,
  coalesce(cpf.split, cls.split, cos.split) as split, coalesce(cpf.label, cls.label, cos.label) as label,
  cpf.score as perspective_fields, cls.score as line_segment, cos.score as object_shadow
  from cpf full outer join cls on cpf.name=cls.name
  full outer join cos on coalesce(cpf.name, cls.name)=cos.name)"""

BLOCKS = """
blk as (select label as sample, vec_id as block,
  list_transform(embedding, lambda v: greatest(0.0, least(255.0, round_even((cast(v as double)+1.0)*128.0, 0)))) as pixels
  from embeddings)"""

MASKS = """
mask as (select vec_id//4 as sample, vec_id as instance, cast(vec_id%2 as int) as klass, label as confidence,
  generate_subscripts(embedding,1)-1 as pixel, (cast(unnest(embedding) as double)+1.0)/2.0 as value from embeddings)"""

ALLOCATION = """
alloc0 as (select *, n*70//100 as f1, n*15//100 as f2, n*15//100 as f3,
  (n*70)%100 as r1, (n*15)%100 as r2, (n*15)%100 as r3 from strata),
alloc1 as (select *, n-f1-f2-f3 as lft from alloc0),
alloc2 as (select *,
  f1+cast(cast(r2>r1 as int)+cast(r3>r1 as int) < lft as int) as a1,
  f2+cast(cast(r1>=r2 as int)+cast(r3>r2 as int) < lft as int) as a2,
  f3+cast(cast(r1>=r3 as int)+cast(r2>=r3 as int) < lft as int) as a3 from alloc1),
alloc as (select * exclude (a1,a2,a3),
  a1-case when n>=3 then cast(a2=0 as int)+cast(a3=0 as int) else 0 end as c_train,
  case when n>=3 then greatest(a2,1) else a2 end as c_val,
  case when n>=3 then greatest(a3,1) else a3 end as c_test from alloc2)"""

SPLITS = ENTRIES + """,
ranked as (select *, row_number() over (partition by generator order by md5('42|'||sample_id), sample_id) as rk,
  count(*) over (partition by generator) as n from ent),
strata as (select distinct generator, n from ranked),""" + ALLOCATION + """,
splits as (select r.sample_id, r.path, r.label, r.generator, r.source, r.content_hash, r.size,
  case when rk<=c_train then 'train' when rk<=c_train+c_val then 'val' else 'test' end as split
  from ranked r join alloc a using (generator))"""

_BENCH = ",".join(f"'{n}'" for n in _NAMES[1:14])
_DIFF = ",".join(f"'{n}'" for n in _NAMES[:11])
_HELD = ",".join(f"'{n}'" for n in _NAMES[11:14])

OOD = SPLITS + f""",
ood as (select * exclude (split), case when label=0 then split when generator in ({_BENCH}) then 'test'
  when generator='latent_diffusion' then case when split='test' then 'train' else split end
  else 'excluded' end as split from splits)"""

FAMILY = SPLITS + f""",
fam as (select * exclude (split), case when label=0 then split when generator in ({_HELD}) then 'test'
  when generator in ({_DIFF}) then case when split='test' then 'train' else split end
  else 'excluded' end as split from splits)"""

FUSION = OOD + """,
fus0 as (select *, label=0 and split='test' as pool from ood where split<>'excluded'),
fus1 as (select *, row_number() over (partition by pool order by md5('fusion42|'||sample_id), sample_id) as rk,
  count(*) over (partition by pool) as n from fus0),
fus as (select sample_id, path, label, generator, source, content_hash, size,
  case when (pool and rk<=case when n>=2 then greatest(n*30//100,1) else 0 end) or (label=1 and generator='glide') then 'fusion' else split end as split from fus1)"""


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr},6) as {name or expr}"


def metrics_sql(source: str, keys: str, threshold: float = 0.5) -> str:
    """Grouped metrics with the AUC from midranks."""
    return f"""
mr as (select {keys}, label, score, rank() over (partition by {keys} order by score)
    + (count(*) over (partition by {keys}, score) - 1)/2.0 as mid from {source} where score is not null),
mm as (select {keys}, count(*) as n_samples,
    count(*) filter (label=0 and score<{threshold}) as tn, count(*) filter (label=0 and score>={threshold}) as fp,
    count(*) filter (label=1 and score<{threshold}) as fn, count(*) filter (label=1 and score>={threshold}) as tp,
    sum(case when label=1 then mid end) as rs from mr group by {keys}),
m as (select {keys}, n_samples, (tp+tn)/n_samples as accuracy,
    coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0.0) as f1,
    (rs-(fn+tp)*(fn+tp+1)/2.0)/nullif((fn+tp)*(tn+fp),0) as auc, tn, fp, fn, tp,
    fp/nullif(fp+tn,0) as fpr, fn/nullif(fn+tp,0) as fnr, tp/nullif(tp+fp,0) as precision,
    tp/nullif(tp+fn,0) as recall from mm)"""


M_COLS = ("n_samples, round(accuracy,6) accuracy, round(f1,6) f1, round(auc,6) auc, tn, fp, fn, tp, "
          "round(fpr,6) fpr, round(fnr,6) fnr, round(precision,6) as precision, round(recall,6) recall")
