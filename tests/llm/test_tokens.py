"""Encoding, the token store and its index against whole-text encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assayer.llm import queries, token_store
from assayer.llm.encode import Encoder
from assayer.session import shared_dir

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "Ö", "é", "é", " ", "  ", "\n", "\t", "'s", "'", "12", ".", ",", " ", "日本", "😀", " \n", "İ",
            "Σ", "́", "<|endoftext|>", "\x1c", "\x0b", "​", "\0"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [queries.BYTE_BPE, queries.WORD_BPE])
@pytest.mark.parametrize("spans", [False, True])
def test_words_encode_like_whole_texts(name, spans):
    draw = random.Random(5)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 14))) for _ in range(5000)]
    texts += [None, "", " ", "x" * 50_000, "word " * 20_000]
    encoder = Encoder(queries.tokenizer_file(name), spans, capacity=500)
    for _ in range(2):      # the second time from memory
        got = encoder.encode(pa.array(texts))
        for t, g, e in zip(texts, got, encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert (g[0] if spans else g).tolist() == e.ids, t
            if spans:
                assert [tuple(p) for p in g[1:].T.tolist()] == e.offsets, t


def expected(rows, name):
    """(doc_id, start, n_tokens, crc) by encoding whole texts one by one."""
    tokenizer, out, start = Tokenizer.from_file(queries.tokenizer_file(name)), [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_op3_matches_whole_text_encoding(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op3_token_store(spark, SF).collect())
    assert got == expected(rows, queries.BYTE_BPE)


def test_store_edge_cases(spark):
    rows = [(None, "without key"), (5, None), (5, ""), (3, "tie"), (3, "tie"), (7, "long " * 30_000), (9, " ")] + [(4, "same")] * 40
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, shard int, offset string")
    store = token_store.write_tokens(docs, shared_dir(spark, "t"), queries.tokenizer_file(queries.BYTE_BPE), n_shards=5)
    got = token_store.stored_documents(store, spark).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]).tolist()
    assert [r.doc_id for r in by_start] == sorted((a for a, _ in rows), key=lambda a: (a is not None, a))
    assert sorted(r.occurrence for r in got if r.doc_id == 4) == list(range(40))
    assert sorted(crc(np.frombuffer(r.ids, "<u4")) for r in got) == sorted(x[3] for x in expected(rows, queries.BYTE_BPE))
    asked = spark.createDataFrame([(3, 1), (3, 1), (3, 2), (8, 0), (None, 0)], "doc_id long, occurrence long")
    assert [(r.doc_id, r.occurrence) for r in token_store.lookup(store, asked).collect()] == [(3, 1)]


def test_empty_store(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = token_store.write_tokens(docs, shared_dir(spark, "t"), queries.tokenizer_file(queries.BYTE_BPE))
    assert token_store.stored_documents(store, spark).count() == 0


def test_perfect_hash_is_a_permutation():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 2500):
        h, h2 = (draw.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        h[: n // 10] = h[0]     # first hashes may collide
        pilots, slot = token_store.perfect_hash(h, h2)
        assert sorted(slot) == list(range(n))
        assert (token_store.probe(pilots, n, h, h2) == slot).all()
