"""Every stage of the pipeline against a plain version of it, on all that the stage before kept."""

import collections

import pytest

import corpus_pipeline
from assayer.llm import mixing, toxicity
from assayer.llm.common import stored
from test_packing import well_packed
from test_pii import plain_spans
from test_simhash import similar_components
from test_tokens import SF, expected


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def rows(stages, name):
    return stages[name].collect()


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    for name in ("toxicity", "simhash", "pii", "mixing"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "toxic grade")
    model = toxicity.fit(stages["documents"], labels)
    want = sorted(r.doc_id for r in rows(stages, "documents") if not model.score(r.text or "")[3])
    assert sorted(r.doc_id for r in rows(stages, "toxicity")) == want


def test_one_of_each_group_stays(stages):
    before = rows(stages, "toxicity")
    roots = similar_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in rows(stages, "simhash")) == sorted(set(roots))


def test_personal_data_is_redacted(stages):
    texts = {r.doc_id: r.text for r in rows(stages, "simhash")}
    after = {r.doc_id: r for r in rows(stages, "pii")}
    assert set(after) == set(texts)
    for d, text in texts.items():
        found = [s.split(":") for s in plain_spans(text)]
        assert not any(text[int(a):int(b)] in after[d].text for _, a, b in found)
        assert found or after[d].text == text or "[" in after[d].text
        assert after[d].n_chars == len(after[d].text)


def test_sources_are_mixed(stages):
    plan = collections.Counter(r.doc_id for r in mixing.plan(stages["pii"]).collect())
    assert collections.Counter(r.doc_id for r in rows(stages, "mixing")) == plan and len(plan) > 100


def test_all_are_packed(stages):
    mixed = [(r.doc_id, r.text) for r in rows(stages, "mixing")]
    sizes = collections.Counter()
    for d, _, n, _ in expected(mixed, "word_bpe_49k.json"):
        sizes[d] += n
    got = collections.Counter()
    for r in rows(stages, "packing"):
        got[r.doc_id] += r.length
    assert got == sizes and well_packed(rows(stages, "packing"), 2048) < sum(sizes.values()) / 2048 * 1.05 + 2


def test_run_returns_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"].columns and got.count() == stages["packing"].count()


def test_stages_take_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            some = stored(stage(spark, some, SF), name)
        assert some.columns[0] == "doc_id"
