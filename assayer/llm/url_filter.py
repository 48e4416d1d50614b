"""URL filter: explicit rules, and a character language-model ratio for every URL that no rule decides.

Two smoothed variable-order Markov models are counted from the URLs that the rules accept and reject (all of them but
a held-out fifth by hash). A character's probability after its context of k - 1 characters is
(count + kinds x probability after the shorter context) / (context count + kinds), kinds being the number of different
characters seen there: contexts that say little hand over to shorter ones, down to 1 / 256. The score of a URL is the
mean over its characters (its end is one) of the difference of the log-probabilities. The held-out URLs calibrate the threshold:
the best mean of both classes' shares judged right, midway to the next score seen.

Only DataFrame operations: URLs are made distinct and counted first, so repeated URLs cost one row; grams are
counted before they are shuffled, and every window or join on grams or contexts holds at most an alphabet of rows for a key but
the last join, which Spark may split.

Defined results: null and empty URLs have no host, path or rule and are scored as an empty text; repeated rows are
judged each for itself; if rules decide nothing for one of the classes, or hold out nothing, the threshold is 0; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

ORDER = 5
ALPHABET = 256.0
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are compared in steps of a thousandth.
STEP = 1000
Rule = tuple[str, str, str]      # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<size, verdict, rule>, else null; block wins a tie."""
    found = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
             for v, h, p in rules]
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,verdict:string,rule:string>")


def _grams(url: Column) -> Column:
    """Each character of the URL, and its end, after the four before it."""
    text = F.concat(F.lit("\x02" * (ORDER - 1)), F.translate(url, UPPER, LOWER), F.lit("\x03"))
    chars = F.split(text, "")
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.array_join(F.slice(chars, i, ORDER), ""))


def log_ratios(grams: DataFrame) -> DataFrame:
    """``grams`` (gram, a, r: counts in accepted and rejected URLs) to (gram, llr)."""
    below = None
    for k in range(1, ORDER + 1):
        level = grams.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("g", 1, k - 1))        # at most an alphabet of rows
        level = level.select("g", "a", "r", *[f(c).over(context).alias(name) for c in "ar" for f, name in (
            (lambda c: F.sum(c), f"n_{c}"), (lambda c: F.sum((F.col(c) > 0).cast("long")), f"t_{c}"))])
        if below is not None:
            level = level.join(below, F.substring("g", 2, k - 1) == F.col("shorter"))
        last = lambda c: F.lit(1 / ALPHABET) if below is None else F.col(f"p_{c}")
        p = [F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * last(c)) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(last(c))
             for c in "ar"]
        below = level.select(F.col("g").alias("shorter"), *[x.alias(f"p_{c}") for c, x in zip("ar", p)])
    return below.select(F.col("shorter").alias("gram"), (F.ln("p_a") - F.ln("p_r")).alias("llr"))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the least score step that is accepted."""
    steps = (scored.filter("held and class <> 0").groupBy("step")
             .agg(F.sum(F.when(F.col("class") == 1, F.col("n")).otherwise(0)).alias("a"),
                  F.sum(F.when(F.col("class") == -1, F.col("n")).otherwise(0)).alias("r")))
    # At most some ten thousand steps, whatever the number of URLs.
    order, every = Window.orderBy("step"), Window.partitionBy()
    judged = steps.select("step", F.lag("step").over(order).alias("before"), F.sum("a").over(every).alias("all_a"), F.sum("r").over(every).alias("all_r"),
                          (F.sum("a").over(every) - F.sum("a").over(order) + F.col("a")).alias("a_kept"), (F.sum("r").over(order) - F.col("r")).alias("r_out"))
    right = F.col("a_kept").cast("decimal(38,0)") * F.col("all_r") + F.col("r_out") * F.col("all_a")
    best = judged.filter("all_a > 0 and all_r > 0").select(right.alias("right"), "step", "before").orderBy(F.desc("right"), "step").limit(1)
    return best.agg(F.coalesce(F.max(F.floor((F.col("step") + F.coalesce("before", "step") + 1) / 2)), F.lit(0)).alias("least"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    text = F.coalesce("url", F.lit(""))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(text.alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    urls = stored(urls.select("url", "n", fitting_rule(host, path, rules).alias("fit"), F.monotonically_increasing_id().alias("id")), "urls")
    side = F.when(F.col("fit.verdict") == "allow", 1).when(F.col("fit.verdict") == "block", -1).otherwise(0)
    held = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    grams = urls.select("id", "n", side.alias("class"), held.alias("held"), F.explode(_grams(F.col("url"))).alias("gram"))
    counted = lambda c: F.sum(F.when((F.col("class") == c) & ~F.col("held"), F.col("n")).otherwise(0))
    ratios = log_ratios(stored(grams.groupBy("gram").agg(counted(1).alias("a"), counted(-1).alias("r")), "grams"))
    scores = grams.select("id", "gram").join(ratios, "gram").groupBy("id").agg(F.avg("llr").alias("score"))
    scored = stored(urls.join(scores, "id").select(
        "url", "n", "fit", side.alias("class"), held.alias("held"), F.round("score", 6).alias("score"),
        F.round(F.round("score", 6) * STEP).cast("long").alias("step")), "scored")
    verdict = F.coalesce("fit.verdict", F.when(F.col("step") >= F.col("least"), "allow").otherwise("block"))
    decided = scored.crossJoin(F.broadcast(_threshold(scored))).select(F.col("url").alias("scored_url"), verdict.alias("verdict"), F.col("fit.rule").alias("rule"), "score")
    return (pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("url")).join(decided, F.col("url") == F.col("scored_url"))
            .select("page_id", "host", "path", "rule", "verdict", "score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def judge_sql(rules: list[Rule]) -> str:
    """The same in DuckDB's SQL, over a view ``pages``."""
    fits = [f"CASE WHEN (host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)}) "
            f"THEN {{'size': {len(h + p)}, 'verdict': {_quoted(v)}, 'rule': {_quoted(h + p)}}} END" for v, h, p in rules]
    lower = f"translate(url, '{UPPER}', '{LOWER}')"
    ctes = [f"""u AS (SELECT url, n, host, path, list_max([{', '.join(fits)}]) AS fit,
      ('0x' || substr(md5(url), 1, 8))::BIGINT % {HELD_OUT} = 0 AS held FROM (
      SELECT url, n, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT coalesce(url, '') AS url, count(*) AS n FROM pages GROUP BY 1)))""",
            f"""g AS (SELECT url, n, fit.verdict AS verdict, held, substr(repeat(chr(2), {ORDER - 1}) || {lower} || chr(3), i, {ORDER}) AS gram
      FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM u))""",
            "c AS (SELECT gram, sum(CASE WHEN verdict = 'allow' AND NOT held THEN n ELSE 0 END) AS a, "
            "sum(CASE WHEN verdict = 'block' AND NOT held THEN n ELSE 0 END) AS r FROM g GROUP BY 1)"]
    for k in range(1, ORDER + 1):
        last = {c: f"{1 / ALPHABET}" if k == 1 else f"b.p_{c}" for c in "ar"}
        p = ", ".join(f"CASE WHEN n_{c} > 0 THEN ({c} + t_{c} * {last[c]}) / (n_{c} + t_{c}) ELSE {last[c]} END AS p_{c}" for c in "ar")
        join = "" if k == 1 else f" JOIN p{k - 1} b ON substr(l.g, 2, {k - 1}) = b.g"
        ctes.append(f"""p{k} AS (SELECT l.g, {p} FROM (SELECT *, sum(a) OVER w AS n_a, sum(r) OVER w AS n_r,
      sum((a > 0)::INT) OVER w AS t_a, sum((r > 0)::INT) OVER w AS t_r FROM (
      SELECT substr(gram, {ORDER - k + 1}, {k}) AS g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM c GROUP BY 1)
      WINDOW w AS (PARTITION BY substr(g, 1, {k - 1}))) l{join})""")
    ctes += [f"""s AS (SELECT *, round(score * {STEP})::BIGINT AS step FROM (SELECT url, round(avg(ln(p_a) - ln(p_r)), 6) AS score
      FROM g JOIN p{ORDER} ON gram = p{ORDER}.g GROUP BY 1) JOIN u USING (url))""",
             """h AS (SELECT step, sum(CASE WHEN fit.verdict = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN fit.verdict = 'block' THEN n ELSE 0 END) AS r
      FROM s WHERE held AND fit IS NOT NULL GROUP BY 1)""",
             """j AS (SELECT step, lag(step) OVER (ORDER BY step) AS before, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r,
      sum(a) OVER () - sum(a) OVER (ORDER BY step) + a AS a_kept, sum(r) OVER (ORDER BY step) - r AS r_out FROM h)""",
             """t AS (SELECT coalesce(max(floor((step + coalesce(before, step) + 1) / 2)), 0) AS least FROM (
      SELECT * FROM j WHERE all_a > 0 AND all_r > 0 ORDER BY a_kept * all_r + r_out * all_a DESC, step LIMIT 1))"""]
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, s.host, s.path, s.fit.rule AS rule, coalesce(s.fit.verdict, CASE WHEN s.step >= t.least THEN 'allow' ELSE 'block' END) AS verdict,
  s.score FROM pages JOIN s ON coalesce(pages.url, '') = s.url, t"""
