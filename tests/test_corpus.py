"""Splits, samples, integrity, paths, uploads, readers, arrivals."""

import os

import pytest
from pyspark.sql import functions as F

from assayer.functions import paths
from assayer.operators import components as comp
from assayer.operators import filters, integrity, ranking, splits
from assayer.plans.corpus import prepare, split_for_protocol
from assayer.sources import readers, sinks
from assayer.streaming import arrivals

PNG = bytes.fromhex("89504E470D0A1A0A") + b"data"


def corpus(spark, **sizes):
    """Manifest with the given number of files per generator; a third may be one generator."""
    rows = [(f"{g}_{i}", f"{'real/coco' if g == 'real' else 'fake/' + g}/{g}_{i}.png", int(g != "real"), g, "coco" if g == "real" else g, f"h{g}{i}")
            for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, path string, label int, generator string, source string, content_hash string")


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


@pytest.mark.parametrize("sizes", [[1, 2, 3, 4, 5, 7, 10, 13, 100, 0]])
def test_allocation(spark, sizes):
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for r in df.select("n", *[c.alias(k) for k, c in splits.allocation(F.col("n")).items()]).collect():
        assert r["train"] + r["val"] + r["test"] == r["n"]
        if r["n"] >= 3:
            assert min(r["train"], r["val"], r["test"]) >= 1


def test_allocation_of_many_splits(spark):
    pct = {"a": 97, "b": 1, "c": 1, "d": 1}
    for n in (4, 5, 9, 1000):
        row = spark.createDataFrame([(n,)], "n bigint").select(*[c.alias(k) for k, c in splits.allocation(F.col("n"), pct).items()]).first()
        assert sum(row) == n and min(row) >= 1


def test_split_is_stratified_exact_and_reproducible(spark):
    c = corpus(spark, real=400, glide=60, gigagan=7, flux=3)
    one = splits.assign_splits(c)
    assert one.count() == c.count()
    got = counts(one, "generator", "split")
    assert got[("real", "train")] == 280 and got[("real", "val")] == 60 and got[("real", "test")] == 60
    assert all(got[("flux", s)] == 1 for s in ("train", "val", "test"))
    again = splits.assign_splits(c.repartition(7)).select("sample_id", "split")
    assert one.select("sample_id", "split").exceptAll(again).isEmpty()
    other = splits.assign_splits(c, seed=7).select("sample_id", "split")
    assert not one.select("sample_id", "split").exceptAll(other).isEmpty()


def test_ranks_equal_a_plain_sort(spark):
    c = corpus(spark, real=50, flux=20)
    from pyspark.sql import Window as W
    from assayer.functions.hashing import seeded_md5
    plain = c.withColumn("r", F.row_number().over(W.partitionBy("generator").orderBy(seeded_md5(3, "sample_id"), "sample_id")))
    ours = ranking.seeded_rank(c, ["generator"], "sample_id", 3)
    assert plain.join(ours, "sample_id").filter("r <> seeded_rank").isEmpty()
    part = ranking.seeded_parts(c, ["generator"], "sample_id", 3, lambda n: [F.lit(0), F.lit(5), F.lit(500)])
    assert part.join(plain, "sample_id").filter("part <> 1 + int(r > 5)").isEmpty()


def test_more_groups_than_may_be_broadcast(spark):
    c = corpus(spark, **{f"g{i}": 10 for i in range(12)})
    parts = lambda: ranking.seeded_parts(c, ["generator"], "sample_id", 1, lambda n: [F.lit(4)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # the cut table is as good as too large
    try:
        shuffled = sorted(map(tuple, parts().select("sample_id", "part").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    broadcast = parts()
    assert shuffled == sorted(map(tuple, broadcast.select("sample_id", "part").collect()))
    assert counts(broadcast, "part") == {(0,): 48, (1,): 72}


def test_out_of_distribution_splits(spark):
    c = corpus(spark, real=40, latent_diffusion=20, glide=20, flux=20, gigagan=20, other=5)
    m = split_for_protocol(c, "ood")
    got = counts(m, "generator", "split")
    assert set(s for g, s in got if g == "latent_diffusion") == {"train", "val"}
    assert got[("flux", "test")] == 20 and got[("gigagan", "test")] == 20 and got[("glide", "fusion")] == 20
    assert got[("real", "fusion")] == 1 and got[("real", "test")] == 5  # 30% of six, floored
    assert not [g for g, _ in got if g == "other"]
    fam = counts(split_for_protocol(c, "ood_family"), "generator", "split")
    assert fam[("gigagan", "test")] == 20 and ("glide", "test") not in fam
    assert set(g for g, _ in counts(split_for_protocol(c, "standard"), "generator", "split")) == {"real", "latent_diffusion"}


def test_samples(spark):
    c = corpus(spark, real=30, flux=9)
    assert counts(splits.balanced_sample(c, 20), "label") == {(0,): 10, (1,): 9}
    assert splits.exact_sample(c, 12).count() == 12 and splits.exact_sample(c, 99).count() == 39
    folds = counts(splits.stratified_folds(c, 5), "label", "fold")
    assert {v for (l, _), v in folds.items() if l == 0} == {6} and max(v for (l, _), v in folds.items() if l == 1) == 2


def test_fixed_size_resample(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, list(range(9))), (3, [])], "sample_id int, items array<int>")
    got = {r["sample_id"]: r["items"] for r in splits.fixed_size_resample(df, "items", 5).collect()}
    assert got[1][:3] == [1, 2, 3] and len(got[1]) == 5 and set(got[1]) <= {1, 2, 3}
    assert len(got[2]) == 5 and got[3] == []


def test_integrity_with_a_hot_duplicate(spark):
    c = corpus(spark, real=60, flux=60).withColumn("content_hash", F.when(F.pmod(F.hash("sample_id"), F.lit(3)) == 0, F.lit("same")).otherwise(F.col("content_hash")))
    n = c.filter("content_hash = 'same'").count()
    g = integrity.duplicate_groups(c).collect()
    assert len(g) == 1 and g[0]["n_copies"] == n
    members = integrity.duplicate_members(c)
    assert members.count() == n and members.select("n_copies").distinct().first()[0] == n
    report = integrity.integrity_report(c).first()
    assert report["n_duplicate_groups"] == 1 and not report["ok"]
    assert integrity.integrity_report(c, check_duplicates=False).first()["ok"]
    broken = c.withColumn("content_hash", F.when(F.col("sample_id") != "real_1", F.col("content_hash")))
    assert integrity.integrity_report(broken).first()["n_corrupted"] == 1
    assert integrity.leakage(splits.assign_splits(c)).count() == 1


def test_posix_paths(spark):
    df = spark.createDataFrame([(r"C:\Users\a\b.png",), (r"D:\dados\b.tar.png",), ("/home/x/b",), (".hidden",)], "p string")
    got = df.select(paths.posix_path(F.col("p")).alias("q"), paths.stem(F.col("p")).alias("s"), paths.suffix(F.col("p")).alias("x")).collect()
    assert [r["q"] for r in got] == ["/mnt/c/Users/a/b.png", "/mnt/d/dados/b.tar.png", "/home/x/b", ".hidden"]
    assert [r["s"] for r in got] == ["b", "b.tar", "b", ".hidden"] and [r["x"] for r in got] == [".png", ".png", "", ""]


@pytest.mark.parametrize("path,length,magic,reason", [
    ("a.png", 10, "89504E470D0A1A0A00000000", "ok"), ("a.JPEG", 10, "FFD8FFE000104A4649460001", "ok"),
    ("a.webp", 10, "524946460000000057454250", "ok"), ("a.tiff", 10, "49492A00", "suffix not allowed"),
    ("a.png", 10, "255044462D312E34", "corrupt or unknown"), ("a.png", 10, "424D3600", "content not allowed"),
    ("a.png", 10 * 1024 * 1024 + 1, "89504E470D0A1A0A", "too large"), ("a.png", 10 * 1024 * 1024, "89504E470D0A1A0A", "ok"),
    ("a.png", 0, "", "corrupt or unknown"), (None, None, None, "no file"), ("a.png", None, None, "not found")])
def test_upload_rules(spark, path, length, magic, reason):
    df = spark.createDataFrame([(path, length, magic)], "p string, n bigint, m string")
    assert df.select(filters.upload_verdict(F.col("p"), F.col("n"), F.col("m")).alias("r")).first()["r"] == reason


def test_normalise_is_per_vector(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", 0.0), ("a", 2.0), ("b", 0.1), ("b", 0.9)], "technique string, score double")
    got = [(r["technique"], r["score"]) for r in filters.normalise_scores(df, ["technique"]).orderBy("technique", "score").collect()]
    assert got[1] == ("a", 0.5) and got[3:] == [("b", 0.1), ("b", 0.9)]


def test_corpus_tree_manifest_and_errors(spark, tmp_path):
    root = tmp_path / "c"
    for folder, n in (("real/coco", 3), ("fake/glide", 4)):
        os.makedirs(root / folder)
        for i in range(n):
            (root / folder / f"x{i}.png").write_bytes(PNG + bytes([i]))
    (root / "fake/glide/copy.png").write_bytes(PNG + bytes([0]))
    scan = readers.scan_corpus(spark, str(root), with_content=True)
    assert counts(scan, "label", "generator", "source") == {(0, "real", "coco"): 3, (1, "glide", "glide"): 5}
    assert "content" not in readers.scan_corpus(spark, str(root)).columns
    assert integrity.duplicate_groups(scan).count() == 3  # x0..x2 exist in both folders
    with pytest.raises(FileNotFoundError):
        readers.scan_corpus(spark, str(tmp_path / "none")).count()
    with pytest.raises(FileNotFoundError, match="prepare"):
        readers.read_manifest(spark, str(tmp_path / "none.csv"))
    out = str(tmp_path / "m")
    assert prepare(scan, out, str(tmp_path / "r"), "ood") is False
    assert readers.read_manifest(spark, out, "train", "parquet").count() == 1
    with pytest.raises(ValueError):
        readers.read_manifest(spark, out, "nope", "parquet")


def test_manifest_csv_round_trip(spark, tmp_path):
    m = splits.assign_splits(corpus(spark, real=10, flux=10))
    path = sinks.write_manifest(m, str(tmp_path / "m.csv"), "csv")
    (tmp_path / "o.csv").write_text("split,label,path,generator\ntest,1,x/y.png,flux\n")
    assert readers.read_manifest(spark, str(tmp_path / "o.csv")).first().asDict() == {"path": "x/y.png", "label": 1, "generator": "flux", "split": "test"}
    back = readers.read_manifest(spark, path)
    assert back.exceptAll(m.select(*back.columns)).isEmpty() and back.count() == 20


def test_component_layouts(spark, tmp_path):
    wide = tmp_path / "w.csv"
    wide.write_text("name,split,label,object_shadow,perspective_fields,line_segment\na,test,0,0.10,0.20,0.30\nb,test,1,0.90, ,0.70\nc,test,1,,,\n")
    t = readers.read_components(spark, str(wide))
    got = {r["name"]: r["m"] for r in t.select("name", comp.aggregate_components().alias("m")).collect()}
    assert got["a"] == pytest.approx(0.2) and got["b"] == pytest.approx(0.8) and got["c"] == 0.5
    old = tmp_path / "o.csv"
    old.write_text("name,split,label,legacy_score\na,test,0,0.12\n")
    r = readers.read_components(spark, str(old)).first()
    assert r["object_shadow"] == 0.12 and r["line_segment"] is None


def test_component_files(spark, tmp_path):
    """Last file wins, failure logs and foreign layouts are skipped, column order does not matter."""
    (tmp_path / "run_1.csv").write_text("arquivo,split,label,escore_t04\na,test,0,0.1\nb,test,1,0.2\n")
    (tmp_path / "run_2.csv").write_text("split,arquivo,escore_t04,label\ntest,b,0.9,1\nval,c,,0\n")
    (tmp_path / "run_3_falhas.csv").write_text("arquivo,split,label,escore_t04\na,test,0,0.7\n")
    (tmp_path / "run_4.csv").write_text("arquivo,split,label,other\na,test,0,0.7\n")
    got = {r["name"]: (r["split"], r["label"], r["score"]) for r in readers.read_component_files(spark, f"{tmp_path}/run_*.csv", "escore_t04").collect()}
    assert got == {"a": ("test", 0, 0.1), "b": ("test", 1, 0.9), "c": ("val", 0, None)}
    with pytest.raises(FileNotFoundError):
        readers.read_component_files(spark, f"{tmp_path}/run_*.csv", "absent")


def test_score_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("image,note,score\nx/a.png,1,9\n")
    (tmp_path / "a.csv").write_text("file,spai\nq/a.png,0.4\nq\\b.png,0.6\nz/a.png,0.5\n")
    got = {r["name"]: r["score"] for r in readers.read_scores(spark, str(tmp_path)).collect()}
    assert got == {"a.png": 0.5, "b.png": 0.6}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.csv").write_text("file,other\nq,1\n")
    with pytest.raises(ValueError, match="score column"):
        readers.read_scores(spark, str(bad))
    pos = tmp_path / "pos"
    pos.mkdir()
    (pos / "a.csv").write_text("score\n0.1\n0.2\n")
    e = spark.createDataFrame([("b",), ("a",)], "path string")
    joined = readers.by_position(e, readers.read_scores(spark, str(pos)), "path")
    assert {(r["path"], r["score"]) for r in joined.collect()} == {("a", 0.1), ("b", 0.2)}
    with pytest.raises(ValueError):
        readers.by_position(e.limit(1), readers.read_scores(spark, str(pos)), "path")


def test_arriving_files_are_scored_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(PNG)
    run = lambda: arrivals.score_arrivals(
        arrivals.arrival_stream(spark, str(folder)), lambda s: s.select("path", F.lit(0.5).alias("score")),
        str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (folder / "b.png").write_bytes(PNG)
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
