"""SimHash fingerprints, bit-sliced links and components against plain Python."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import components, queries, simhash
from test_tokens import SF


def plain_fingerprint(text, words=4):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).replace(b"\x0b", b" ").split()
    shingles = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    lowest = {}
    for i, d in enumerate(ids):
        lowest[find(i)] = min((x for x in (d, lowest.get(find(i))) if x is not None), default=None)
    return [lowest[find(i)] for i in range(len(ids))]


def test_op1_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [plain_fingerprint(t) for _, t in docs]
    want = {(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, plain_components([d for d, _ in docs], prints))}
    got = queries.op1_simhash(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t"), (8, "a"), (8, "a"), (None, "A"), (None, None), (2, "W " * 40_000), (3, "É é"), (1, "x y z w v")]
    docs = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, text string, fingerprint int, root int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = [(d, s, c) for (d, _), s, c in zip(rows, signed, plain_components([d for d, _ in rows], prints))]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 8]


@pytest.mark.parametrize("radius,tile", [(4, 4096), (4, 50), (2, 20), (8, 4096)])
def test_links_are_exact_in_dense_balls(spark, radius, tile):
    draw = np.random.default_rng(radius)
    centre = draw.integers(0, 2**63, 5, dtype=np.uint64)
    near = np.repeat(centre, 80)
    for _ in range(radius):
        near ^= np.where(draw.random(len(near)) < 0.7, np.uint64(1) << draw.integers(0, 64, len(near)).astype(np.uint64), np.uint64(0))
    values = np.unique(np.concatenate([near, draw.integers(0, 2**63, 200, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    stars = components.connected(simhash.near_links(table, radius, tile)).collect()
    root = {r.node: r.root for r in stars}
    want = plain_components(values.view(np.int64).tolist(), values.tolist(), radius)
    assert [root.get(v, v) for v in values.view(np.int64).tolist()] == want


def test_small_buckets_are_exact():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(9):
        y ^= np.where(draw.random(500) < 0.6, np.uint64(1) << draw.integers(0, 64, 500).astype(np.uint64), np.uint64(0))
    distance = np.array([bin(int(a) ^ int(b)).count("1") for a, b in zip(x, y)])
    for radius in range(10):
        assert (simhash.linked_pairs(x, y, radius) == (distance <= radius)).all()


def test_components_of_chains_and_stars(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 3000).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = components.connected(chain.unionByName(star).repartition(16)).groupBy("root").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 301), (1000, 2000)]
    assert components.connected(chain.limit(0)).count() == 0


def shingles(text, words=5):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).replace(b"\x0b", b" ").split()
    return {b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def similar_components(docs, similarity=0.8, words=5):
    """The smallest doc_id of each document's group, by comparing all sets of shingles that share any."""
    sets = [shingles(t, words) for _, t in docs]
    holders, root = {}, list(range(len(docs)))
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(docs))]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_one_of_each_similar_group(spark, sf):
    """Against all pairs with any shingle in common: nine of ten doomed copies go at least, and nothing else does."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    want = set(similar_components(docs))
    kept = [r.doc_id for r in simhash.one_of_each_similar(table).collect()]
    assert len(kept) == len(set(kept)) and want <= set(kept)
    assert len(kept) - len(want) <= 0.1 * (len(docs) - len(want))


@pytest.mark.parametrize("tile", [4096, 7])
def test_similar_groups_with_repeated_and_unknown_ids(spark, tile):
    import random
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = draw.choices(words, k=120)
    rows = [(1, " ".join(draw.choices(words, k=60))), (1, " ".join(draw.choices(words, k=60))), (None, "one two"), (None, "One  two"), (None, None), (7, ""), (8, " "),
            (9, "a b c d e f"), (9, "a b c d e f"), (10, "W " * 40_000)]
    for i in range(60):
        copy = list(base)
        copy[draw.randrange(120)] = "other"
        rows.append((100 + i, " ".join(copy)))
    docs = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, text string, node int, k1 int").repartition(5)
    got = simhash.one_of_each_similar(docs, tile=tile)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [d for d, _ in kept].count(1) == 2 and {d for d, _ in kept} == {1, None, 7, 9, 10, 100} and len(kept) == 7
    assert simhash.one_of_each_similar(docs.limit(0)).count() == 0
