"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

Layout of a store: ``payload/ids-00000.bin`` raw little-endian ids in ascending key order, ``entries`` (one row
for each document), ``shards`` (one row for each file) and ``index``. The index cuts keys by hash into buckets of
about ``BUCKET`` keys. A bucket of n keys is a perfect hash onto its n slots: small groups of keys get a pilot
each that sends them to free slots, single keys the free slot itself; a slot holds a fingerprint of the
key and where its ids lie. A lookup computes bucket, pilot and slot, whatever the size of the store.

Defined results: null text is an empty document (only the end id); documents with a repeated key are told
apart by ``occurrence`` (0, 1, ... in store order); a null key is stored first, has no index entry and is found
by ``entries`` alone; an empty table gives a store without entries. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions
from .encode import encoder

BUCKET = 2048
#: Documents of a shard are read back in tasks of at most about so many bytes.
READ_BYTES = 8 << 20
LOCATED = "doc_id bigint, occurrence bigint, shard int, offset bigint, n_tokens bigint"


@dataclass(frozen=True)
class TokenStore:
    path: str
    width: int          # bytes of an id
    n_buckets: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _filesystem(path: str):
    """Local, HDFS or object store alike; tasks and the driver name the same shared folder."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(path)


def _runs(keys: pa.Array, last: tuple[object, int]) -> tuple[np.ndarray, tuple[object, int]]:
    """How many equal keys stand directly before each key, going on from the batch before."""
    values = keys.to_numpy(zero_copy_only=False)
    known = ~np.asarray(keys.is_null())
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    new[1:] &= known[1:] | known[:-1]
    starts = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    count = np.arange(len(values)) - starts
    if len(values) and keys[0].as_py() == last[0]:
        count[starts == 0] += last[1]
    return count, (keys[-1].as_py(), int(count[-1]) + 1) if len(values) else last


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2,
                 n_shards: int | None = None) -> TokenStore:
    """Encode whole texts and write them in ascending doc_id order; one shuffle, of the texts.

    ``width`` 2 holds vocabularies of up to 65,536 ids, 4 all others. A shard is written under a name of its own and
    moved into place at its end, so a repeated task replaces it whole.
    """
    spark = docs.sparkSession
    fs, root = _filesystem(path)
    fs.create_dir(f"{root}/payload", recursive=True)

    def shard_writer(batches):
        files, folder = _filesystem(path)
        codec, shard = encoder(tokenizer), TaskContext.get().partitionId()
        final = f"{folder}/payload/ids-{shard:05d}.bin"
        unfinished, offset, last = f"{final}.{uuid.uuid4().hex}", 0, (object(), 0)
        with files.open_output_stream(unfinished) as out:
            for batch in batches:
                for part, texts in codec.pieces(batch, "text"):
                    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
                    flat = np.full(sizes.sum(), end_id, f"<u{width}")
                    body = np.ones(len(flat), bool)
                    body[np.cumsum(sizes) - 1] = False
                    flat[body] = np.concatenate(texts) if texts else flat[:0]
                    out.write(flat.tobytes())
                    offsets = offset + (np.cumsum(sizes) - sizes) * width
                    offset += flat.nbytes
                    count, last = _runs(part.column("doc_id"), last)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(count), pa.array(np.full(len(sizes), shard, np.int32)),
                         pa.array(offsets), pa.array(sizes)],
                        ["doc_id", "occurrence", "shard", "offset", "n_tokens"])
        files.move(unfinished, final)

    (docs.select(F.col("doc_id").cast("long"), "text")
     .repartitionByRange(n_shards or partitions(spark), "doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(shard_writer, LOCATED)
     .write.parquet(f"{path}/entries"))
    _write_shards(spark, path, width)
    return _write_index(spark, path, width)


def _write_shards(spark: SparkSession, path: str, width: int) -> None:
    """For each file: ids before it, and how often its first key has occurred before it.

    Only one row for each file comes to the driver.
    """
    rows = (spark.read.parquet(f"{path}/entries").groupBy("shard")
            .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("n"),
                 F.max_by("occurrence", "offset").alias("run")).orderBy("shard").collect())
    out, start, key, run = [], 0, None, 0
    for r in rows:
        before = run if r["first"] is not None and r["first"] == key else 0
        out.append((r["shard"], start, r["first"], before))
        run = r["run"] + 1 + (before if r["first"] == r["last"] else 0)
        key, start = r["last"], start + r["n"]
    (spark.createDataFrame(out, "shard int, ids_before bigint, first_key bigint, occurred bigint")
     .coalesce(1).write.parquet(f"{path}/shards"))


def _hashes(n_buckets: int) -> list:
    h = F.xxhash64(F.lit(1), "doc_id", "occurrence")
    return [h.alias("h"), F.xxhash64(F.lit(2), "doc_id", "occurrence").alias("h2"),
            F.pmod(F.xxhash64(F.lit(3), "doc_id", "occurrence"), F.lit(n_buckets)).alias("bucket")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slots(h: np.ndarray, h2: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(h ^ _mixed(h2 + pilot.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def perfect_hash(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of about n / 4 groups, and the slot of each of the n keys (a permutation of 0..n-1)."""
    n = len(h)
    groups = max(1, -(-n // 4))
    of = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=groups)
    begins = np.cumsum(sizes) - sizes
    pilots, slot, free = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        keys = order[begins[g]:begins[g] + sizes[g]]
        if len(keys) < 2:
            break
        base = 0
        while True:
            tried = np.arange(base, base + 64)
            places = _slots(h[keys][None, :], h2[keys][None, :], tried[:, None], n)
            ordered = np.sort(places, axis=1)
            good = free[places].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                break
            base += 64
        pilots[g] = tried[good.argmax()]
        slot[keys] = places[good.argmax()]
        free[slot[keys]] = False
    single = np.flatnonzero(sizes == 1)
    keys = order[begins[single]]
    slot[keys] = np.flatnonzero(free)
    pilots[single] = -1 - slot[keys]
    return pilots, slot


def probe(pilots: np.ndarray, n: int, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each key: two hashes and one look at the pilots."""
    pilot = pilots[(h % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot.astype(np.int64), _slots(h, h2, np.maximum(pilot, 0), n))


def _write_index(spark: SparkSession, path: str, width: int) -> TokenStore:
    entries = spark.read.parquet(f"{path}/entries").filter("doc_id is not null")
    n_buckets = max(1, -(-entries.count() // BUCKET))
    carried = F.when(F.col("doc_id") == F.col("first_key"), F.col("occurred")).otherwise(0)
    # One row for each file: as many as the writer had tasks.
    keyed = entries.join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard").select(
        "doc_id", (F.col("occurrence") + carried).alias("occurrence"), "shard", "offset", "n_tokens")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h, h2 = rows["h"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
        pilots, slot = perfect_hash(h, h2)
        by_slot = rows.iloc[np.argsort(slot)]
        prints = (by_slot["h2"].to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        return pd.DataFrame([{
            "bucket": rows["bucket"].iloc[0], "n": len(rows), "pilots": pilots.tobytes(), "fingerprints": prints.tobytes(),
            "shards": by_slot["shard"].to_numpy(np.int32).tobytes(),
            "offsets": by_slot["offset"].to_numpy(np.int64).tobytes(),
            "sizes": by_slot["n_tokens"].to_numpy(np.int64).tobytes()}])

    (keyed.select("*", *_hashes(n_buckets)).groupBy("bucket")
     .applyInPandas(build, "bucket bigint, n bigint, pilots binary, fingerprints binary, shards binary, offsets binary, sizes binary")
     .write.parquet(f"{path}/index"))
    return TokenStore(path, width, n_buckets)


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Where the documents of (doc_id, occurrence) lie, by the index alone.

    Keys repeated in the question are answered once; keys not in the store give no row (but for one unknown key in
    2^32, whose fingerprint agrees by chance).
    """
    index = store.table(keys.sparkSession, "index")

    def find(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame(columns=["doc_id", "occurrence", "shard", "offset", "n_tokens"])
        row = rows.iloc[0]
        h, h2 = asked["h"].to_numpy().view(np.uint64), asked["h2"].to_numpy().view(np.uint64)
        slot = probe(np.frombuffer(row["pilots"], np.int32), int(row["n"]), h, h2)
        known = np.frombuffer(row["fingerprints"], np.uint32)[slot] == (h2 >> np.uint64(32)).astype(np.uint32)
        at = slot[known]
        return pd.DataFrame({
            "doc_id": asked["doc_id"].to_numpy()[known], "occurrence": asked["occurrence"].to_numpy()[known],
            "shard": np.frombuffer(row["shards"], np.int32)[at], "offset": np.frombuffer(row["offsets"], np.int64)[at],
            "n_tokens": np.frombuffer(row["sizes"], np.int64)[at]})

    asked = keys.select("doc_id", "occurrence").filter("doc_id is not null").distinct().select("*", *_hashes(store.n_buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, LOCATED)


def read_ids(store: TokenStore, located: DataFrame) -> DataFrame:
    """``located`` with ``ids``: the ids read from the files, as little-endian unsigned 32-bit integers."""
    path, width = store.path, store.width

    def reader(batches):
        files, folder = _filesystem(path)
        opened, handle = None, None
        for batch in batches:
            shards, offsets, sizes = (batch.column(c).to_numpy() for c in ("shard", "offset", "n_tokens"))
            group = np.cumsum(sizes * 4) // (4 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids = []
                for shard, offset, size in zip(shards[a:b], offsets[a:b], sizes[a:b]):
                    if shard != opened:
                        opened, handle = shard, files.open_input_file(f"{folder}/payload/ids-{shard:05d}.bin")
                    handle.seek(int(offset))
                    ids.append(np.frombuffer(handle.read(int(size) * width), f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(ids, pa.binary())],
                                                 [*batch.schema.names, "ids"])

    spark = located.sparkSession
    return (located.repartition(partitions(spark), "shard", F.floor(F.col("offset") / READ_BYTES))
            .sortWithinPartitions("shard", "offset").mapInArrow(reader, f"{LOCATED}, ids binary"))


def stored_documents(store: TokenStore, spark: SparkSession) -> DataFrame:
    """Every document of the store with its ids and ``start`` (ids of all documents before it), found by key."""
    shards = F.broadcast(store.table(spark, "shards"))     # one row for each file
    entries = store.table(spark, "entries").join(shards, "shard")
    carried = F.when(F.col("doc_id") == F.col("first_key"), F.col("occurred")).otherwise(0)
    keys = entries.select("doc_id", (F.col("occurrence") + carried).alias("occurrence"))
    nameless = entries.filter("doc_id is null").select("doc_id", "occurrence", "shard", "offset", "n_tokens")
    found = lookup(store, keys).unionByName(nameless)
    return read_ids(store, found).join(shards.select("shard", "ids_before"), "shard").select(
        "doc_id", "occurrence", (F.col("ids_before") + F.col("offset") / store.width).cast("long").alias("start"),
        "n_tokens", "ids")
