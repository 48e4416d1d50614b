"""URL rules and language-model scores against the SQL twin and plain Python."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from assayer.llm import queries, url_filter
from oracle_check import compare, connect

URLS = ["http://A.Example.ORG/en/12", "https://x.org", "http://org/", "http://xorg/a", "http://a.com/fr/1?b://c", "http://a.com/de/#x", "b.net/x", None, "",
        "http://é.net/Ü/😀", "http://a.net/" + "x" * 3000, "HTTP://b.ORG?/q", "http://b.org/\n/z", "http://b.net/fr/2", "http://c.net/de/3", "://", "http://a.com/DE/"]


def test_op5_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.LLM_QUERIES["op5_url_filter"](spark, sf), connect(sf), queries.LLM_ORACLES["op5_url_filter"]) is None


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, 1, "h") for i, u in enumerate(URLS * 2 + [f"http://{'ab'[i % 2]}.{['org', 'com'][i % 2]}/{['en', 'de'][i % 2]}/{i}" for i in range(300)])]
    return spark.createDataFrame(rows, "page_id long, url string, n int, score string")


def test_rules_and_edge_cases(spark, pages):
    rows = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        host, path, (verdict, rule) = plain(p.url, queries.URL_RULES)
        r = rows[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), p.url
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    # What no rule decides goes with what it looks like.
    new = spark.createDataFrame([(1000, "http://b.net/de/17"), (1001, "http://a.net/en/17")], "page_id long, url string")
    judged = url_filter.judge(pages.select("page_id", "url").unionByName(new), queries.URL_RULES)
    assert {r.page_id: r.verdict for r in judged.filter("page_id >= 1000").collect()} == {1000: "block", 1001: "allow"}
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge(pages, []).filter("rule is not null").count() == 0


def test_probabilities(spark):
    """Both models against the recursion written out, and each a distribution."""
    counts = {"abcde": (3, 1), "abcdf": (1, 0), "xbcde": (0, 2), "xbcdg": (2, 2), "aaaaa": (1, 1)}
    rows = spark.createDataFrame([(g, a, r) for g, (a, r) in counts.items()], "gram string, a long, r long")
    got = {r.gram: r.llr for r in url_filter.log_ratios(rows).collect()}

    def p(gram, side):
        if not gram:
            return 1 / 256
        ctx = gram[:-1]
        seen = Counter()
        for g, n in counts.items():
            tail = g[5 - len(gram):]
            if tail[:-1] == ctx and n[side]:
                seen[tail] += n[side]
        below = p(gram[1:], side)
        total = sum(seen.values())
        return (seen[gram] + len(seen) * below) / (total + len(seen)) if total else below

    for g in counts:
        assert math.isclose(got[g], math.log(p(g, 0)) - math.log(p(g, 1)), abs_tol=1e-12)


def test_only_expressions(spark, pages):
    plan = url_filter.judge(pages, queries.URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
