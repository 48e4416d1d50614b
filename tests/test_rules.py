"""Small rules: what counts as finite, balanced, readable; plans of constant size."""

import pytest
from pyspark.sql import functions as F

from assayer import session
from assayer.operators import features, filters, fusion, integrity
from assayer.plans import corpus
from assayer.sources import readers


def test_sigmoid_rule_looks_at_finite_scores(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 0.2), ("a", inf), ("b", 0.3), ("b", nan), ("c", 2.0), ("c", 0.0)], "t string, score double")
    got = {(r.t, round(r.score, 4)) for r in filters.normalise_scores(df, ["t"]).collect() if r.score == r.score and r.score != inf}
    assert got == {("a", 0.2), ("b", 0.3), ("c", 0.8808), ("c", 0.5)}


def test_missing_scores_are_imputed_also_where_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.7), (3, None)], "id int, T01 double")
    rows = fusion.imputed(df, ["T01"], {"T01": 0.5}).orderBy("id").collect()
    assert [(r.T01, r.has_T01) for r in rows] == [(0.5, 0.0), (0.7, 1.0), (0.5, 0.0)]


def test_resize_of_a_short_signal_is_empty(spark):
    df = spark.createDataFrame([(1, [7.0])], "sample_id int, pixels array<double>")
    rows = features.perturb_signal(df).filter("kind = 'resize'").collect()
    assert rows and all(None not in r.pixels and len(r.pixels) == int(r.level) for r in rows)


def test_one_to_one_allows_one_file(spark):
    def flag(real, fake):
        labels = [(0, "real")] * real + [(1, "x")] * fake
        return integrity.class_balance(spark.createDataFrame(labels, "label int, generator string")).first().balanced
    assert flag(50, 51) and flag(200, 202) and not flag(50, 52) and not flag(200, 203)


def test_text_named_like_an_image_is_corrupt(spark, tmp_path):
    good = bytes.fromhex("89504E470D0A1A0A") + b"pixels"
    for folder, name, content in (("real/cam", "a.png", good + b"1"), ("fake/gen", "b.png", good + b"2"), ("fake/gen", "bad.png", b"not an image")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    entries = readers.scan_corpus(spark, str(tmp_path), with_content=True)
    report = integrity.integrity_report(entries).first()
    assert (report.n_total, report.n_corrupted, report.ok) == (3, 1, False)
    bad = integrity.problem_files(entries, integrity.unreadable(entries), F.lit(False)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.png"]
    sized = entries.withColumn("side", F.when(F.col("path").endswith("b.png"), 128).otherwise(256))
    assert not corpus.prepare(sized, str(tmp_path / "m"), str(tmp_path / "r"), "ood", width="side", height="side", expected=256)
    listed = spark.read.parquet(str(tmp_path / "r_files")).collect()
    assert sorted((r.sample_id.rsplit("/", 1)[1], r.problem) for r in listed) == [("b.png", "wrong_size"), ("bad.png", "corrupted")]
    assert spark.read.parquet(str(tmp_path / "r_duplicates")).count() == 0


def test_large_planes(spark):
    """Pairs of a 256 x 256 plane, and its blocks, in plans that don't grow with it."""
    plane = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(256 * 256 - 1)), lambda k: (k * 7 + k / 256).cast("int") % 5).alias("p"))
    values = plane.first().p
    for dy, dx in ((0, 1), (1, 0), (-1, 2)):
        want = {}
        for y in range(max(0, -dy), 256 - max(0, dy)):
            for x in range(256 - dx):
                key = (values[y * 256 + x], values[(y + dy) * 256 + x + dx])
                want[key] = want.get(key, 0) + 1
        assert {(r.i, r.j): r.n for r in features.plane_pairs(plane, ["id"], "p", 256, 256, dy, dx).collect()} == want
    blocks = {r.block_no: r.p for r in features.split_planes(plane, "p", 256, 256).collect()}
    assert len(blocks) == 1024
    assert blocks[33] == [values[(8 + y) * 256 + 8 + x] for y in range(8) for x in range(8)]


def test_unhashed_files_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "sample_id long, content_hash string")
    assert sorted(r.sample_id for r in integrity.duplicate_members(df).collect()) == [1, 2]


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="shared folder"):
        session.shared_dir(Session, "x")
    Context.master = "local[4]"
    assert session.shared_dir(Session, "x")
