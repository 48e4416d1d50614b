"""Near words against a plain comparison of all pairs, and the whole query against its SQL twin."""

import random
import zlib
from collections import Counter

import pytest

from assayer.llm import queries, variants
from oracle_check import compare, connect


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op12_matches_sql(spark, sf):
    assert compare(queries.LLM_QUERIES["op12_variants"](spark, sf), connect(sf), queries.LLM_ORACLES["op12_variants"]) is None


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts: dict[str, int], ratio: int = 5):
    form, n_near = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        n_near[w] = len(found)
        top = min(found, key=lambda x: (-counts[x], x), default=None)
        if top is not None and counts[top] >= ratio * n:
            form[w] = top
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, n_near[w], counts.get(form.get(w))) for w, n in counts.items())


@pytest.mark.parametrize("letters,size,least,frequent,tile", [("ab", 500, 4, 3, 4096), ("ab", 700, 6, 20, 16), ("abé", 900, 6, 0, 50), ("abcdefgh", 900, 5, 8, 4096)])
def test_no_near_pair_is_lost(spark, letters, size, least, frequent, tile):
    """Few letters make repeated grams, long lists and tiles; edits of words make near pairs in every place."""
    draw = random.Random(size)
    words = {"".join(draw.choices(letters, k=draw.randint(least, 11))) for _ in range(size // 2)}
    for w in list(words):
        i = draw.randrange(len(w) + 1)
        words.add(w[:i] + draw.choice(letters + "z") + w[i + draw.randrange(2):])
        words.add(w + draw.choice(letters))
    counts = {w: 5 ** draw.randint(1, 5) for w in sorted(words) if len(w) >= least}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, variants.variants(df, least, 5, frequent, tile).collect()), key=lambda r: r[0]) == plain(counts)


def test_counting_words(spark):
    texts = [(1, "Über ÜBERALL überall abcdefg ABCDEFG naïveté×÷ a1bcdefg"), (2, "straßen straßen Straßen"), (3, ""), (4, None), (None, "abcdefg abcdefg"),
             (5, " ".join(["keeper"] * 300)), (5, " ".join(["keeper"] * 300)), *[(10 + i, "abcdefghij") for i in range(600)]]
    import re
    want = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in texts], "doc_id long, text string, word string, n int")
    assert dict(map(tuple, variants.count_words(docs, 6, 1).collect())) == dict(want)
    assert any(len(w) == 9 for w in want)                   # a letter was taken out
    got = variants.spelling_variants(docs, 6, 1).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain(dict(want))


def test_very_long_words_and_empty_tables(spark):
    long = "ab" * 40_000
    df = spark.createDataFrame([(long, 5), (long + "c", 50), (long[1:], 7), (long[:500] + "x" + long[501:], 9), ("abcdef", 5)], "word string, n long")
    got = {len(r.word): (r.n_near, r.form is None, len(r.root)) for r in variants.variants(df).collect() if "x" not in r.word}
    assert got == {80_000: (3, False, 80_001), 80_001: (1, True, 80_001), 79_999: (1, True, 79_999), 6: (0, True, 6)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        variants.near_pairs(df, least=3)
