"""Files in many parts: nothing lost, order kept."""

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from assayer.catalog import QUERIES
from assayer.sources import readers, sinks


def write(df, path, parts):
    ranged = df.repartitionByRange(parts, "id").sortWithinPartitions("id") if parts > 1 else df.coalesce(1).sortWithinPartitions("id")
    ranged.drop("id").write.option("header", True).csv(path)


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_scores_of_all_parts(spark, tmp_path, parts):
    rows = spark.range(997).select("id", F.concat(F.lit("a\\b\\"), "id", F.lit(".png")).alias("path"), (F.col("id") / 1000).cast("string").alias("score"))
    write(rows, str(tmp_path / "named"), parts)
    got = {r.name: r.score for r in readers.read_scores(spark, str(tmp_path / "named")).collect()}
    assert got == {f"{i}.png": i / 1000 for i in range(997)}
    write(rows.select("id", "score"), str(tmp_path / "bare"), parts)
    (tmp_path / "bare" / "part-99999-empty.csv").write_text("score\n")
    scores = readers.read_scores(spark, str(tmp_path / "bare"))
    assert sorted((r.position, r.score) for r in scores.collect()) == [(i, i / 1000) for i in range(997)]
    entries = spark.range(997).select(F.format_string("img_%05d", "id").alias("name"))
    aligned = readers.by_position(entries.repartition(7), scores, "name").collect()
    assert {r.name: r.score for r in aligned} == {f"img_{i:05d}": i / 1000 for i in range(997)}
    with pytest.raises(ValueError, match="997 scores for 5 entries"):
        readers.by_position(entries.limit(5), scores, "name")


def test_positions_over_blocks_of_large_files(spark, tmp_path):
    """Files are read in blocks by different tasks; later parts have larger numbers than fit five digits."""
    for part, start in (("part-00009", 0), ("part-99999", 3000), ("part-100000", 6000)):
        (tmp_path / f"{part}.csv").write_text("score\n" + "".join(f"{(start + i) / 10000:.4f}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.position, r.score) for r in readers.read_scores(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i / 10000) for i in range(9000)]


def test_a_single_file_comes_before_others(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image,prediction\nx.png,0.5\nx.png,0.75\n")
    (tmp_path / "b.csv").write_text("image,prediction\ny.png,0.1\n")
    assert [tuple(r) for r in readers.read_scores(spark, str(tmp_path)).collect()] == [("x.png", 0.75)]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_newest_result_of_many_parts(spark, tmp_path, parts):
    rows = spark.range(100).select("id", F.lit("T02").alias("technique"), F.concat(F.lit("g"), "id").alias("generator"), F.lit(0.5).alias("auc"))
    write(rows.withColumn("auc", F.lit(0.1)), str(tmp_path / "run_1"), parts)
    write(rows, str(tmp_path / "run_2"), parts)
    for by in ("name", "path"):
        got = readers.latest_result(spark, f"{tmp_path}/*", "technique string, generator string, auc double", "T02", by)
        assert [tuple(r) for r in got.groupBy("auc").count().collect()] == [(0.5, 100)]


def test_component_files_of_many_layouts(spark, tmp_path):
    """Quoted headers, columns in any order, a layout without the column, a failure log; the last file wins."""
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "a.csv").write_text('"arquivo","split","label","value, raw","value"\nx.png,train,1,"1,5",0.25\ny.png,test,0,,\n'.replace("arquivo", readers.NAME_COLUMNS[0]))
    (folder / "b.csv").write_text(f"value,label,split,extra,more,{readers.NAME_COLUMNS[0]}\n0.75,1,val,e,m,x.png\n0.5,0,val,e,m,z.png\n")
    (folder / "c.csv").write_text(f"{readers.NAME_COLUMNS[0]},split,label,other\nx.png,val,1,0.9\n")
    (folder / f"d_{readers.FAILURE_LOG_MARK}.csv").write_text(f"{readers.NAME_COLUMNS[0]},split,label,value\nx.png,val,1,0.99\n")
    (folder / "e.csv").write_text("")
    got = {r["name"]: (r["split"], r["label"], r["score"]) for r in readers.read_component_files(spark, str(folder), "value").collect()}
    assert got == {"x.png": ("val", 1, 0.75), "y.png": ("test", 0, None), "z.png": ("val", 0, 0.5)}
    with pytest.raises(FileNotFoundError, match="no file with column nothing"):
        readers.read_component_files(spark, str(folder), "nothing")


def test_corpus_is_listed_by_levels(spark, tmp_path):
    for name in ("real/cam/a.png", "real/cam/deep/b.png", "fake/gen/c.png", "fake/gen/_tmp.png", "fake/gen/.d.png", "fake/.hidden/e.png", "other/x/f.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = readers.list_corpus(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.generator, r.size, r.hidden) for r in rows) == [
        (".d.png", "gen", 5, True), ("_tmp.png", "gen", 5, True), ("a.png", "real", 5, False), ("b.png", "real", 5, False), ("c.png", "gen", 5, False)]
    listed, read = (readers.scan_corpus(spark, str(tmp_path), c).select("path", "size", "label", "generator", "source", "sample_id") for c in (False, True))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, read.collect()))
    with pytest.raises(FileNotFoundError, match="corpus not found"):
        readers.scan_corpus(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("parts", [1, 3])
def test_arrivals_of_a_table_in_parts(spark, tmp_path, parts):
    """A table is one file or a folder of parts; the stream of either holds all of its rows, once."""
    rows = spark.range(30).select(F.col("id").alias("page_id"), F.lit("https://example.org/").alias("url"), F.lit("<p>é</p>").alias("html"))
    rows.repartition(parts).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(9).select(F.col("id").alias("event_id"), (F.col("id") * 100.0).alias("value")).repartition(parts).write.parquet(str(tmp_path / "parts"))
    if parts > 1:
        (tmp_path / "parts").rename(tmp_path / "events.parquet")
    else:
        next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    got = {r.side: r.n for r in QUERIES["arrival_validation"](spark, str(tmp_path)).collect()}
    kept = sum(i % 5 != 3 and i % 4 in (0, 1) for i in range(30))
    assert got == {"accepted": kept, "rejected": 30 - kept}
    assert sorted(r.event_id for r in QUERIES["arrival_scores"](spark, str(tmp_path)).collect()) == list(range(9))


def test_rows_become_files_without_renames(spark, tmp_path, monkeypatch):
    """One file a row, whatever names the folders have; copies and repeated ids are kept, and Spark's writer, which renames each file, isn't used."""
    rows = [(i % 7, "real" if i % 3 else "fake", ["src0", "a/b: c", None][i % 3 if i % 5 else 0], None if i == 4 else "é" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, top string, source string, text string")
    monkeypatch.setattr(DataFrameWriter, "text", None)
    root = sinks.write_files(df, str(tmp_path / "corpus"), ["top", "source"], "text", "doc_id")
    sinks.write_files(df, root, ["top", "source"], "text", "doc_id")        # run again: replaced
    got = readers.scan_corpus(spark, root).groupBy("label", "source").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    want = {}
    for _, top, source, text in rows:
        name = {"a/b: c": "a%2Fb%3A c", None: "__HIVE_DEFAULT_PARTITION__"}.get(source, source)
        n, b = want.get((int(top == "fake"), name), (0, 0))
        want[int(top == "fake"), name] = n + 1, b + (0 if text is None else len(text.encode()) + 1)
    assert {(r.label, r.source): (r.n, r.b) for r in got} == want
    monkeypatch.undo()
    monkeypatch.setattr(sinks, "can_open", lambda path: False)
    sinks.write_files(df, str(tmp_path / "other"), ["top", "source"], "text", "doc_id")
    assert readers.scan_corpus(spark, str(tmp_path / "other")).count() == 200
