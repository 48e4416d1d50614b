"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 where it is set in over half the XXH64 values (seed 42) of a document's word shingles.
Fingerprints that differ in at most ``radius`` of 64 bits are linked, exactly: cut into ``radius + d`` blocks of bits, two such
fingerprints agree in at least d whole blocks, so each is sent to one bucket for every choice of d blocks.
A bucket is compared bit-sliced: bit planes stand vertically, 64 fingerprints to a machine word; carry-save
counters add up a plane of differences at a time, and words in which every lane exceeds the radius are left out.
Only a spanning star of each bucket's components is emitted, never its pairs. Buckets of more than
``TILE`` fingerprints are cut into tiles and every pair of tiles is a task of its own.

Equal texts meet in one fingerprint before anything is compared, so groups of exact copies cost nothing.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle: the whole sequence; repeated rows are all returned; a null doc_id gets its component's smallest
known doc_id; an empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import fresh, partitions, stored
from .components import LINK, connected, forest

TILE = 4096
LANE = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words; blanks are those of ASCII, A-Z become a-z."""
    from xxhash import xxh64_intdigest as digest

    line = b" ".join(text.lower().split())
    if not line:
        return []
    spaces = (np.flatnonzero(np.frombuffer(line, np.uint8) == 32)).tolist()
    if len(spaces) < words:
        return [digest(line, 42)]
    begins, ends = [0, *(s + 1 for s in spaces[:len(spaces) - words + 1])], [*spaces[words - 1:], len(line)]
    return [digest(line[a:b], 42) for a, b in zip(begins, ends)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; a group without hashes has zero.

    Eight bits of a hash are added as eight byte lanes of one word, in runs of at most 255 so that none overflows.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANE, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint) of whole texts; no shuffle."""

    def each(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // 4_000_000)) + 1), len(size)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in texts.slice(a, b - a).to_pylist()]
                if hashes:
                    out.append(majority(np.concatenate(hashes), np.fromiter(map(len, hashes), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id bigint, fingerprint bigint")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes of 64 values to a word, lane i of word w being value 64 w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(planes, n_planes: int, words: int, radius: int, shape: tuple = ()) -> np.ndarray:
    """Bit set of the lanes with at most ``radius`` ones; ``planes(b, live)`` gives plane b at the live words.

    The counters are bit-sliced too: they start so that the count overflows into ``over`` just when it
    exceeds the radius. Every eight planes the words with all lanes over are abandoned.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    live = np.arange(words)
    counters = [np.full((*shape, words), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(width)]
    over = np.zeros((*shape, words), np.uint64)
    for b in range(n_planes):
        carry = planes(b, live)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b > radius:
            keep = (over != ~np.uint64(0)).reshape(-1, len(live)).any(axis=0)
            if not keep.all():
                live, over, counters = live[keep], over[..., keep], [c[..., keep] for c in counters]
            if not len(live):
                break
    out = np.zeros((*shape, words), np.uint64)
    out[..., live] = ~over
    return out


def lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), bitorder="little", axis=-1)[..., :n].astype(bool)


def linked_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the candidate pairs lie within the radius; the lanes are the pairs."""
    planes = bit_planes(left ^ right)
    return lanes(within_radius(lambda b, live: planes[b, live], 64, planes.shape[1], radius), len(left))


def linked_group(values: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``queries`` (positions) to all ``values``, thinned to the components' stars."""
    planes, root = bit_planes(values), np.arange(len(values))
    bits = np.unpackbits(values[queries].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    flip = np.where(bits, ~np.uint64(0), np.uint64(0))
    for at in range(0, len(queries), 64):
        some = flip[at:at + 64]
        near = lanes(within_radius(lambda b, live: planes[b, live][None, :] ^ some[:, b, None], 64, planes.shape[1], radius,
                                   (len(some),)), len(values))
        for q, row in zip(queries[at:at + 64], near):
            found = root[row]
            if (found != root[q]).any():
                labels = np.unique(np.append(found, root[q]))
                root[np.isin(root, labels)] = labels[0]
    other = root != np.arange(len(values))
    return values[other], values[root[other]]


def _bucket_links(radius: int):
    """Links within runs of rows (bucket, a, b, tile, fingerprint), rows sorted so that a bucket's tiles stand together."""

    def links(keys: np.ndarray, tile: np.ndarray, a: np.ndarray, values: np.ndarray):
        new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(new, len(values)))
        out = []
        # Small buckets: the lanes are the pairs of many buckets at once.
        few = new[(sizes > 1) & (sizes <= 16)]
        n = sizes[(sizes > 1) & (sizes <= 16)]
        for gap in range(1, int(n.max(initial=1))):
            first = np.concatenate([few[n > gap] + k for k in range(16 - gap)]) if (n > gap).any() else few[:0]
            end = np.concatenate([(few + n)[n > gap]] * (16 - gap)) if len(first) else first
            first = first[first + gap < end]
            for at in range(0, len(first), 1 << 16):
                x, y = values[first[at:at + (1 << 16)]], values[first[at:at + (1 << 16)] + gap]
                near = linked_pairs(x, y, radius)
                out.append((x[near], y[near]))
        for s, size in zip(new[sizes > 16], sizes[sizes > 16]):
            part = slice(s, s + size)
            # Two tiles: the first asks, all answer. One tile: each asks.
            out.append(linked_group(values[part], np.flatnonzero(tile[part] == a[part]), radius))
        if out:
            x, y = (np.concatenate(c).view(np.int64) for c in zip(*out))
            return forest(x, y)
        return None

    def batches_of(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "a", "b")])
            found = links(keys, rows.column("tile").to_numpy(), keys[1], rows.column("fingerprint").to_numpy().view(np.uint64))
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "a", "b")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            done = last[-1] + 1 if len(last) else 0      # the last bucket may go on in the next batch
            if done:
                yield from flush(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return batches_of


def blocks_for(radius: int, key_bits: int = 21) -> int:
    """Blocks to cut a fingerprint into so that a bucket's key has ``key_bits`` bits; links are exact for any number.

    More bits mean fewer unrelated fingerprints in a bucket and more buckets for each fingerprint. 21 bits suit some
    tens of millions of distinct fingerprints.
    """
    blocks = radius + 1
    while 64 * (blocks - radius) < key_bits * blocks:
        blocks += 1
    return blocks


def near_links(values: DataFrame, radius: int, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links between distinct ``fingerprint`` values, thinned but with the same components."""
    blocks = blocks or blocks_for(radius)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    mask = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(signed(sum(mask[k] for k in kept)))))
            for i, kept in enumerate(combinations(range(blocks), blocks - radius))]
    # Dealt first: a stored table has few splits, and each row becomes dozens.
    rows = values.repartition(partitions(values.sparkSession), "fingerprint").select("fingerprint", F.explode(F.array(*keys)).alias("bucket"))
    # Few: each takes more than ``tile`` rows. Spark broadcasts the stored table only if it is small.
    hot = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > tile), "hot")
    tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1))
    dealt = (rows.join(hot, "bucket", "left").withColumn("tiles", tiles.cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "fingerprint"), "tiles").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fingerprint"))
    return (dealt.repartition(partitions(values.sparkSession), "bucket", "a", "b")
            .sortWithinPartitions("bucket", "a", "b").mapInArrow(_bucket_links(radius), LINK))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(near_links(nodes.select("fingerprint"), radius, tile))
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted = stored(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(component, "fingerprint").select("doc_id", "fingerprint", "component_id")


def minima(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """Bucket keys (document, band): each hashes the least of a document's shingles in ``rows`` orders of their own."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(hashes * odd[b, r], starts)
            key = (key ^ least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, b] = key ^ (key >> np.uint64(32))
    return out


def _hashed(batch: pa.RecordBatch, words: int):
    """Runs of a batch's rows, with the hashes of their shingles and the number of each text's. A text without words has one, zero."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        hashes = [np.array(shingle_hashes(t, words) or [0], np.uint64) for t in texts.slice(a, b - a).to_pylist()]
        if hashes:
            yield batch.slice(a, b - a), np.concatenate(hashes), np.fromiter(map(len, hashes), np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, size, fingerprint, buckets) of whole texts; ``docs`` has doc_id, k1, k2 and text. No shuffle."""

    def each(batches):
        for batch in batches:
            for part, hashes, sizes in _hashed(batch, words):
                keys = minima(hashes, np.cumsum(sizes) - sizes, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes), pa.array(majority(hashes, sizes).view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))],
                    ["doc_id", "k1", "k2", "size", "fingerprint", "buckets"])

    return docs.mapInArrow(each, "doc_id bigint, k1 bigint, k2 bigint, size bigint, fingerprint bigint, buckets array<bigint>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct hashes of a text's shingles, sorted; ``texts`` has node and text."""

    def each(batches):
        for batch in batches:
            for part, hashes, sizes in _hashed(batch, words):
                ends = np.cumsum(sizes)
                sets = [np.unique(hashes[e - n:e]).tobytes() for n, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(each, "node bigint, shingles binary")


def similar_in_group(values: np.ndarray, sets: list[np.ndarray], block: np.ndarray, cross: bool, radius: int, similarity: float):
    """Links, by position, of a bucket's texts whose fingerprints lie within the radius and whose shingles are similar, exactly.

    Distances are compared bit-sliced, 64 texts against all. Of the texts near one, all are verified at once, unless they are connected to it already.
    """
    sizes = np.fromiter(map(len, sets), np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked, root, out = np.zeros(int(codes.max()) + 1, bool), np.arange(len(values)), []
    planes = bit_planes(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    flip = np.where(bits, ~np.uint64(0), np.uint64(0))
    for at in range(0, len(values), 64):
        some = flip[at:at + 64]
        near = lanes(within_radius(lambda b, live: planes[b, live][None, :] ^ some[:, b, None], 64, planes.shape[1], radius,
                                   (len(some),)), len(values))
        for i, row in enumerate(near, at):
            row[:i + 1] = False
            if cross:
                row &= block != block[i]
            row &= root != root[i]
            if row.any():
                mine = codes[starts[i]:starts[i] + sizes[i]]
                marked[mine] = True
                both = np.add.reduceat(marked[codes].astype(np.int64), starts)
                marked[mine] = False
                found = np.flatnonzero(row & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
                if len(found):
                    out += [(i, j) for j in found.tolist()]
                    labels = np.unique(np.append(root[found], root[i]))
                    root[np.isin(root, labels)] = labels[0]
    return out


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float, tile: int = TILE, volume: int = 1 << 23) -> DataFrame:
    """(a, b): links between nodes whose texts are similar, thinned but with the same components.

    ``nodes`` has node, k1, k2, least, size, fingerprint and buckets; ``texts`` k1, k2, doc_id and text. Of buckets with the same texts one is searched. Buckets of
    more than ``tile`` texts, or more than ``volume`` shingles, are cut into tiles and every pair of tiles is a group.
    """
    spark = nodes.sparkSession
    rows = nodes.select("node", "size", "fingerprint", F.explode("buckets").alias("bucket"))
    met = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"),
                                     F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y")).filter("n > 1")
    searched = stored(met.groupBy("n", "shingles", "x", "y").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("shingles") / volume)).cast("int").alias("tiles")), "searched")
    members = stored(rows.join(searched, "bucket").select("bucket", "node", "fingerprint", "tiles"), "members")
    wanted = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "k1", "k2", "least"), "wanted")
    same = (texts.k1 == wanted.k1) & (texts.k2 == wanted.k2) & texts.doc_id.eqNullSafe(wanted.least)
    sets = shingle_sets(texts.join(wanted, same).select("node", "text"), words).dropDuplicates(["node"])
    block = F.pmod(F.xxhash64(F.lit(7), "node"), "tiles").cast("int")
    dealt = (members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "fingerprint").join(sets, "node"))
    group = ["bucket", "a", "b"]

    def search(batches):
        def links(rows: pa.Table):
            keys = np.stack([rows.column(c).to_numpy() for c in group])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), rows.num_rows]
            block, node, values = (rows.column(c).to_numpy() for c in ("block", "node", "fingerprint"))
            sets, out = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1:
                    out += [(s + i, s + j) for i, j in similar_in_group(values[s:e].view(np.uint64), sets[s:e], block[s:e], keys[1, s] != keys[2, s], radius, similarity)]
            if out:
                x, y = np.array(out).T
                a, b = forest(node[x], node[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(c).to_numpy() for c in group])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            done = other[-1] + 1 if len(other) else 0                   # the last bucket may go on in the next batch
            if done:
                yield from links(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return dealt.repartition(partitions(spark), *group).sortWithinPartitions(*group).mapInArrow(search, LINK)


def one_of_each_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 22, bands: int = 10, rows: int = 4, tile: int = TILE) -> DataFrame:
    """One document of each group of documents with similar texts: Jaccard of the sets of word shingles of ``similarity`` or more, verified exactly.

    Texts meet in buckets, one for each band of least shingle hashes, where their fingerprints are compared bit-sliced; ``radius`` is wide (texts of similarity 0.8 differ in
    9.7 of 64 bits on average) and only spares comparisons of sets. With ten bands of four, pairs of similarity 0.8 meet with probability 0.995, others of more
    surely. Of a group the row with the smallest doc_id stays (unknown ones last, then by text hash), and one of rows that repeat. Texts without words are alike.
    """
    k1, k2 = fresh("k1"), fresh("k2")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(k1, F.xxhash64(F.lit(1), text)).withColumn(k2, F.xxhash64(F.lit(2), text))
    texts = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text")
    seen = stored(sketches(texts, words, bands, rows), "sketches")
    nodes = seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fingerprint").alias("fingerprint"), F.first("buckets").alias("buckets"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = connected(similar_links(nodes, texts, words, radius, similarity, tile))
    first = F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "k1", "k2")).alias("first")
    kept = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first)
            .select(F.col("first.least").alias("least"), F.col("first.k1").alias("x"), F.col("first.k2").alias("y")))
    kept = stored(kept, "kept")
    here = (keyed[k1] == kept.x) & (keyed[k2] == kept.y) & keyed["doc_id"].eqNullSafe(kept.least)
    return keyed.join(kept, here, "left_semi").dropDuplicates([k1, k2]).select(docs.columns)


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, and one row of it where rows repeat.

    Rows without doc_id can't be named by a group and all stay. Texts are shuffled once, by doc_id.
    """
    kept = near_duplicates(docs, words, radius).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    nameless = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(nameless)
