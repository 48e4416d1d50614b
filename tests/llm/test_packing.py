"""Packing: every piece once, gapless sequences, and as few of them as the lower bound allows."""

import collections
import itertools

import numpy as np

from assayer.llm import packing, queries
from assayer.llm.common import stored
from test_tokens import SF, expected


def well_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_op10_matches_whole_text_encoding(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = queries.op10_packing(spark, SF).collect()
    sequences = well_packed(rows, 2048)
    whole = {d: n for d, _, n, _ in expected(docs, queries.WORD_BPE)}
    crcs = {d: c for d, _, n, c in expected(docs, queries.WORD_BPE) if n <= 2048}
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(whole)
    for d, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [2048 * k for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == whole[d] and all(r.length == 2048 for r in pieces[:-1])
        if whole[d] <= 2048:
            assert pieces[0].ids_crc32 == crcs[d]
    lengths = np.array([r.length for r in rows])
    assert sequences <= packing.lower_bound(lengths, 2048) + 1


def test_many_cells_and_rounds(spark):
    lengths = np.random.default_rng(1).integers(1, 80, 3000)
    rows = [(int(i // 2), 0, 0, int(n), 1) for i, n in enumerate(lengths)] + [(7, 0, 0, 100, 1)] * 40
    pieces = spark.createDataFrame(rows, packing.PIECE)
    out = packing.pack(pieces, 100, cell=128, islands=2, epochs=2, generations=10).collect()
    assert collections.Counter((r.doc_id, r.length) for r in out) == collections.Counter((a, d) for a, _, _, d, _ in rows)
    assert well_packed(out, 100) <= 1.01 * packing.lower_bound(np.array([r[3] for r in rows]), 100) + 2


def test_partitions_and_splits_make_no_difference(spark):
    """Any partitions give equal results within the limit, also where files are split anew between the jobs."""
    lengths = np.random.default_rng(1).integers(1, 80, 3000)
    rows = [(int(i // 2), 0, 0, int(n), 1) for i, n in enumerate(lengths)] + [(7, 0, 0, 100, 1)] * 40 + [(8, 0, 0, 50, 1)] * 20
    pieces, found = spark.createDataFrame(rows, packing.PIECE), []
    solve, split = packing.pack_cells, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    try:
        for n in (1, 4, 6, 8, 32):
            def pack_cells(*a, **k):
                out = stored(solve(*a, **k), "solved")
                spark.conf.set(split, str(4096 * (n % 5 + 1)))
                return out
            packing.pack_cells = pack_cells
            out = packing.pack(pieces.repartition(n), 100, cell=128, islands=2, epochs=2, generations=10).collect()
            spark.conf.set(split, before)
            assert well_packed(out, 100) <= 1.01 * packing.lower_bound(np.array([r[3] for r in rows]), 100) + 2
            found.append(sorted(tuple(r) for r in out if r.length < 100))
    finally:
        packing.pack_cells = solve
        spark.conf.set(split, before)
    assert all(f == found[0] for f in found)


def brute_force(lengths, capacity):
    best = len(lengths)
    for of in itertools.product(range(len(lengths)), repeat=len(lengths)):
        if np.bincount(of, lengths).max() <= capacity:
            best = min(best, len(set(of)))
    return best


def test_small_packings_are_best():
    draw = np.random.default_rng(2)
    for _ in range(12):
        lengths = np.sort(draw.integers(1, 10, 5))[::-1].copy()
        best = brute_force(lengths, 10)
        assert packing.lower_bound(lengths, 10) <= best
        assert packing.evolve(lengths, 10, [], 40, 6, draw)[0].max() + 1 == best


def test_crossover_keeps_every_piece_once():
    draw = np.random.default_rng(4)
    lengths = np.sort(draw.integers(1, 60, 200))[::-1].copy()
    a, b = draw.permutation(200), np.zeros(200, np.int64)
    packing.best_fit(np.arange(200), lengths, b, [], 100)
    for _ in range(20):
        a = packing.crossover(a, b, lengths, 100, draw)
        assert a.min() >= 0 and np.bincount(a, lengths).max() <= 100


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, cell long")
    assert packing.packed_documents(empty, queries.tokenizer_file(queries.WORD_BPE)).count() == 0
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "tie", 1), (2, "tie", 1), (3, "a b " * 5000, 1)], "doc_id long, text string, row long")
    rows = packing.packed_documents(docs, queries.tokenizer_file(queries.WORD_BPE)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 0, 2048), (3, 1, 2048),
                                                                      (3, 2, 2048), (3, 3, 2048), (3, 4, 1809)]
    assert well_packed(rows, 2048) == 5
