"""Codes against a plain version in Python integers and the SQL twin."""

import hashlib

import numpy as np
import pytest

from assayer.llm import code_trie, queries
from oracle_check import compare, connect


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op11_matches_sql(spark, sf):
    assert compare(queries.LLM_QUERIES["op11_code_trie"](spark, sf), connect(sf), queries.LLM_ORACLES["op11_code_trie"]) is None


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label), usable and of one length."""
    vectors = [[int(np.floor(scale * x)) for x in v] for _, v, _ in rows]
    w = len(vectors[0]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for v in vectors]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, vectors[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        chosen = [[near(c[p], p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(first)):
                mine = [c[p] for c, k in zip(cut, chosen) if k[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes = [[near(c[p], p) for p in range(parts)] for c in cut]
    error = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    total = {}
    for (_, _, label), e in zip(rows, error):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for k in c), e, total[label], sha) for (i, _, label), c, e in zip(rows, codes, error))


def coded(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_trie.compress(df).collect())


def test_shared_prefixes_ties_and_copies(spark):
    """Few values, so that prefixes are shared, distances tie and a third of the rows are copies."""
    draw = np.random.default_rng(3)
    rows = [(int(i), (draw.integers(-3, 4, 24) / 4096).tolist(), int(i % 3) if i % 5 else None) for i in range(400)]
    rows += [(500 + i, rows[7][1], 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert coded(df) == coded(df.repartition(5)) == plain(rows)


def test_a_walk_goes_on_over_blocks(monkeypatch):
    draw = np.random.default_rng(4)
    x = np.unique(draw.integers(-4, 5, (3000, 5)), axis=0)
    entries = draw.integers(-4, 5, (9, 5))
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for block in (1, 7, 100, 10_000):
        monkeypatch.setattr(code_trie, "BLOCK", block)
        walk = code_trie.Walk(entries)
        got = [walk.leaves(part) for part in np.array_split(x, 4)]
        assert (np.concatenate([g[0] for g in got]) == far.argmin(axis=1)).all()
        assert (np.concatenate([g[1] for g in got]) == far.min(axis=1)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    full = lambda x: [float(x)] * 8
    rows = [(1, full(1), None), (1, full(1), None), (2, full(-2), "a"), (None, full(5), "a"), (3, None, "a"), (4, full(nan), "a"), (5, full(inf), "b"), (6, [None] * 8, "b"),
            (7, full(1.5), "b")]
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], "vec_id long, embedding array<double>, label string, part string, code string")
    assert coded(df) == plain([r for r in rows if r[0] in (1, 2, 7) or r[0] is None])
    assert code_trie.compress(df.limit(0)).count() == 0
    short = spark.createDataFrame([(1, [1.0], 0), (2, [], 0), (3, full(1), 0)], "vec_id long, embedding array<double>, label int")
    assert coded(short) == plain([(1, [1.0] + [0.0] * 7, 0), (2, [0.0] * 8, 0), (3, full(1), 0)])
    with pytest.raises(Exception, match="too large"):
        code_trie.compress(spark.createDataFrame([(0, full(1e12), 0)], "vec_id long, embedding array<double>, label int")).collect()
