"""Attribution of tokens to sections against a count character by character."""

import collections
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayer.llm import queries, token_counts
from test_tokens import SF


def brute_force(spans, sections, rule, n_chars):
    counts, outside = [0.0] * len(sections), 0.0
    for s, e in spans:
        chars = list(range(s, e)) or [min(s, max(n_chars - 1, 0))]
        homes = [next((k for k, (a, b) in enumerate(sections) if a <= c < b), None) for c in chars]
        votes = collections.Counter(homes)
        if rule == "split":
            for k, n in votes.items():
                if k is None:
                    outside += n / len(chars)
                else:
                    counts[k] += n / len(chars)
            continue
        pick = {"start": homes[0], "end": homes[-1],
                "majority": min(votes, key=lambda k: (-votes[k], k is None, k or 0))}[rule]
        if pick is None:
            outside += 1
        else:
            counts[pick] += 1
    return counts, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules(rule):
    draw = random.Random(rule)
    for _ in range(300):
        n = draw.randint(0, 20)
        cuts = sorted(draw.randint(0, n) for _ in range(2 * draw.randint(0, 4)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        spans, at = [], 0
        while at < n:
            width = draw.randint(0, 4)
            spans.append((at, min(n, at + width)))
            at += max(1, width)
        spans.append((n, n))
        got = token_counts.attribute(np.array(spans).T, np.array(sections, np.int64).reshape(-1, 2), rule, n)
        want = brute_force(spans, sections, rule, n)
        assert np.allclose(got[0], want[0]) and np.isclose(got[2], want[1]), (spans, sections)


def test_op4_matches_whole_text_encoding(spark):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    got = collections.defaultdict(dict)
    for r in queries.op4_token_counts(spark, SF).collect():
        got[r.doc_id][r.section] = (r.begin, r.end, r.n_tokens)
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        at, sections = 0, []
        for line in (d.text or "").splitlines(keepends=True) if set(d.text or "") & {"\n"} else [d.text or ""]:
            sections.append((at, at + len(line)))
            at += len(line)
        e = tokenizer.encode(d.text or "", add_special_tokens=False)
        counts, outside = brute_force(e.offsets, sections, "majority", len(d.text or ""))
        assert not outside
        assert got[d.doc_id] == {k: (*s, c) for k, (s, c) in enumerate(zip(sections, counts))}


def test_sections_given_and_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, []), (1, None, []), (None, "", [(0, 0)]), (2, "abc def", [(0, 2), (5, 7)]), (3, "\n\na" * 30_000, None)],
        "doc_id long, text string, parts array<struct<begin:int,end:int>>")
    rows = token_counts.count_tokens(docs, queries.tokenizer_file(queries.BYTE_BPE), "split", "parts").collect()
    assert [(r.doc_id, r.section, r.n_tokens) for r in rows if r.doc_id is None] == [(None, 0, 0.0)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 2) == 2 and any(r.section == -1 for r in rows)
    by_line = token_counts.count_tokens(docs.withColumn("section", docs.doc_id), queries.tokenizer_file(queries.BYTE_BPE)).collect()
    assert [(r.section, r.begin, r.end, r.n_tokens) for r in by_line if r.doc_id == 1] == [(0, 0, 0, 0.0)] * 2
    assert sum(r.doc_id == 3 for r in by_line) == 60_001
    assert token_counts.count_tokens(docs.limit(0), queries.tokenizer_file(queries.BYTE_BPE)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, "", "first")


def test_a_long_text_of_many_paragraphs_takes_time_in_proportion():
    """Tokens of two line breaks cross a boundary each; ten megabytes of them end soon."""
    import time
    text = "some words of a paragraph\n\n" * 370_000
    where = token_counts.lines(text)
    cuts = np.arange(0, len(text) + 1, 27)
    spans = np.stack([np.sort(np.concatenate([cuts[:-1], cuts[1:] - 2])), np.sort(np.concatenate([cuts[1:] - 2, cuts[1:]]))])
    began = time.time()
    counts, crossing, outside = token_counts.attribute(spans, where, "majority", len(text))
    assert time.time() - began < 30
    assert counts.sum() == spans.shape[1] and crossing.sum() == 2 * (len(cuts) - 1) and not outside
