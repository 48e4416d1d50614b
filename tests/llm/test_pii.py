"""Spans against Python's regular expressions; added spans, redaction and edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import pii, queries
from test_tokens import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


TRICKY = [
    "", None, "a@b.c-d_e@f.gh a@b.c@d.e @x.y a@@b.c x@y. é.a@b.c.d..", "999.1.1.1.5.5.5.5 1.2.3.4.5.6.7.8.9 12..3.4.5.6 0000255.1.1.01 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111- 4111  1111 41111111111111111111111 5 4111111111111111", "+1 (988) 555-2485 +49 170 1234567 ++1 2345678 9 +12 +1...........2 (+33) 1 23 45 67 89",
    "日本 a@b.jp 😀 10.0.0.1", "1" * 20000, "a." * 20000 + "@b.c", "a@" + "b." * 5000 + "c", "4 " * 9000, "+" + "1-" * 9000 + "1", "1.2.3.4." * 1500,
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = docs.select("doc_id", pii.joined(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for r in got:
        assert r.s == ",".join(plain_spans(TRICKY[r.doc_id])), TRICKY[r.doc_id][:80]


def test_op9_matches_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in pii.KINDS)
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


@pytest.fixture(scope="module")
def model(spark):
    text = "case when id % 5 = 0 then concat('call +1 (', 200 + id % 700, ') 555-', 1000 + id, ' now') when id % 5 = 1 then concat('see 10.', id % 200, '.7.9 up') " \
           "when id % 5 = 2 then concat('mail u', id, '@m.example.com ok') when id % 5 = 3 then concat('order ', 100000000000 + id * 7919, 'x done') else concat('v ', id, ', 300, 400, 500') end"
    return pii.fit(spark.range(600).select(F.col("id").alias("doc_id"), F.expr(text).alias("text")), precision=0.9)


def test_trees_add_spans_of_like_format(spark, model):
    docs = spark.createDataFrame([(1, "call (988) 555-2485 now"), (2, "order 123456789012x done"), (3, "nothing 12 here")], "doc_id long, text string")
    rows = {r.doc_id: r.s for r in pii.find_spans(docs, model).select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert rows == {1: "phone:5:19", 2: "", 3: ""}


def test_redaction_and_edge_cases(spark, model):
    docs = spark.createDataFrame([(1, "to a@b.cd, 10.0.0.1!", 5, "x"), (1, "to a@b.cd, 10.0.0.1!", 5, "x"), (2, None, 5, "y"), (None, "", 5, "z")],
                                 "doc_id long, text string, base int, spans string")
    out = pii.redacted(docs, model)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r.base, r.spans) for r in out.collect()), key=str) == [
        (0, "", 5, "z"), (1, "to [EMAIL], [IP]!", 5, "x"), (1, "to [EMAIL], [IP]!", 5, "x"), (2, None, 5, "y")]
    assert pii.find_spans(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_only_expressions(spark, model):
    plan = pii.find_spans(spark.read.parquet(f"{SF}/documents.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


DISGUISED = {
    "email": ["bob.lee (at) mail3 (dot) example (dot) org", "bob.lee[at]example[dot]org", "bob.lee at example dot org", "bob.lee at example.org", "bob.lee @ example.org"],
    "ip": ["10[.]20[.]0[.]1", "192 . 168 . 7 . 21", "172(.)16(.)4(.)250"],
    "card": ["4111.1111.1111.1111", "4111/1111/1111/1111", "4111_1111_1111_1111"],
    "phone": ["(988) 555-2485", "988-555-2485", "988.555.2485", "1 988 555 2485"],
}
CLEAN = ["look at this. Then go", "meet me at 10.30 or later", "rows 10, 20, 30, 40, 50", "parts 810[.]20[.]0[.]1", "item 4111.1111.1111.1112", "serial 7-988-555-2485-5"]


def test_disguised_spans_are_added_and_prose_is_left_alone(spark):
    """A model of the real table finds disguised data planted in its texts, and adds nothing to the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    plain = {r.doc_id: (r.text or "", r.s) for r in pii.find_spans(docs, model).select("doc_id", "text", pii.joined("spans").alias("s")).collect()}
    extra = {i: set(s.split(",")) - set(plain_spans(t)) - {""} for i, (t, s) in plain.items()}
    assert sum(bool(e) for e in extra.values()) <= 0.01 * len(plain)
    places, planted, want = sorted(plain)[:100], [], []
    for n, i in enumerate(places):
        words = plain[i][0].split(" ")[:30]
        for kind, forms in DISGUISED.items():
            begin = len(" ".join(words)) + 1
            words.append(forms[n % len(forms)])
            want.append((i, f"{kind}:{begin}:{begin + len(words[-1])}"))
            words += ["und", "then", "the", "others", CLEAN[n % len(CLEAN)], "of", "it"]
        planted.append((i, " ".join(words)))
    found = {r.doc_id: r.s.split(",") for r in pii.find_spans(spark.createDataFrame(planted, "doc_id long, text string"), model)
             .select("doc_id", pii.joined("spans").alias("s")).collect()}
    for kind in DISGUISED:
        of_kind = [(i, w) for i, w in want if w.startswith(kind)]
        assert sum(w in found[i] for i, w in of_kind) >= 0.8 * len(of_kind), kind
    right = {(i, w) for i, w in want} | {(i, w) for i, t in planted for w in plain_spans(t)}
    wrong = [(i, w) for i in found for w in found[i] if w and (i, w) not in right]
    assert len(wrong) <= 0.05 * len(want), wrong[:5]
