"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is the largest in [0, 1] (1
keeps the shares, 0 makes all sources equal) at which the weights' entropy is at least ``entropy`` of that of equal weights; where a
source would then be read more than ``most_epochs`` times, the exponent is raised until it isn't. Both are found by
bisection and the exponent is rounded to six decimals. A weight times the budget is the source's token budget. Whole passes
over the source are taken as often as they fit; of one more pass, the documents up to the first that doesn't fit; shorter ones
behind it are not taken, so a source may stay under its budget by up to the length of that document, and a source whose first document is
longer than a budget of less than one pass gives none.

The order of a pass: documents are dealt by hash into blocks of about ``BLOCK``; each pass permutes the blocks, and
the documents in them, by hashes of its own. So tokens before a document are a sum over blocks plus a sum within its block, and
no source, however large, is sorted in one task. ``mixed`` needs no order of texts at all: each row compares its place
in the last pass with the place where the budget ends.

Tokens are words (runs of characters that aren't ASCII white space). Only DataFrame operations.

Defined results: null and empty texts have no tokens and take no budget; a null source is the source ''; rows repeated with the
same doc_id and tokens fit or don't fit together; sources without tokens have weight 0 and are read once; an empty table
gives no rows. More than ``MOST_SOURCES`` sources are refused, since weights travel to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, stored

BLOCK = 1024
MOST_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"
STEPS = 50


def _draw(*parts) -> Column:
    """60 bits of md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _units(docs: DataFrame) -> DataFrame:
    """Documents counted by source, doc_id and tokens; repeated rows collapse before they are shuffled."""
    return docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
                       "doc_id", _tokens().alias("tokens")).groupBy("source", "key", "doc_id", "tokens").agg(F.count("*").alias("copies"))


def exponent(shares: Column, entropy: float, most_epochs: float, budget_share: Column) -> Column:
    """Of an array of positive shares; ``budget_share`` is the budget over all tokens."""
    total = lambda t: F.aggregate(F.transform(shares, lambda s: F.pow(s, t)), F.lit(0.0), lambda a, x: a + x)
    spread = lambda t: F.aggregate(F.transform(shares, lambda s: F.pow(s, t)), F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    enough = lambda t: F.ln(total(t)) - spread(t) / total(t) >= entropy * F.ln(F.size(shares))
    rare = lambda t: F.pow(F.array_min(shares), t) / total(t) * budget_share <= most_epochs * F.array_min(shares)

    def bisect(holds, holds_low: bool):
        """Where ``holds`` changes between 0 and 1; the end at which it holds."""
        ends = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def halve(e, _):
            middle = (e["low"] + e["high"]) / 2
            to_low = holds(middle) if holds_low else ~holds(middle)
            return F.struct(F.when(to_low, middle).otherwise(e["low"]).alias("low"), F.when(to_low, e["high"]).otherwise(middle).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), ends, halve)["low" if holds_low else "high"]

    by_entropy = F.when(enough(F.lit(1.0)), 1.0).otherwise(bisect(enough, True))
    by_epochs = F.when(rare(F.lit(0.0)), 0.0).otherwise(bisect(rare, False))
    return F.round(F.greatest(by_entropy, by_epochs), 6)


def weights(units: DataFrame, entropy: float, most_epochs: float, budget: int | None) -> DataFrame:
    """(source, n_blocks, total, weight, epochs, rest): whole passes, and tokens left for one more; one row for each source."""
    sources = stored(units.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"), F.sum("copies").alias("n")), "sources")
    if sources.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    whole = sources.agg(F.sum("total").alias("all"), F.sort_array(F.collect_list(F.when(F.col("total") > 0, F.col("total")))).alias("totals"))
    asked = F.lit(budget).cast("long") if budget is not None else F.col("all")
    whole = whole.select("all", asked.alias("budget"), F.transform("totals", lambda t: t / F.col("all")).alias("shares"))
    whole = whole.select("*", exponent(F.col("shares"), entropy, most_epochs, F.col("budget") / F.col("all")).alias("exponent"))
    whole = whole.select("*", F.aggregate(F.transform("shares", lambda s: F.pow(s, F.col("exponent"))), F.lit(0.0), lambda a, x: a + x).alias("norm"))
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.col("all"), F.col("exponent")) / F.col("norm")).otherwise(0.0)
    # One row beside one row for each source.
    out = sources.crossJoin(F.broadcast(whole)).select("source", "n", "total", F.round(weight, 9).alias("weight"), "budget")
    share = F.floor(F.col("weight") * F.col("budget")).cast("long")
    positive = F.greatest("total", F.lit(1))
    return stored(out.select(
        "source", F.ceil(F.col("n") / BLOCK).alias("n_blocks"), "total", "weight",
        F.floor(share / positive).cast("long").alias("epochs"), (share % positive).alias("rest")), "weights")


def _order(seed: int, epoch: Column) -> list[Column]:
    block = F.pmod(_draw(F.lit(seed), "key"), F.col("n_blocks"))
    return [_draw(F.lit(seed), "source", epoch, block).alias("block_key"), _draw(F.lit(seed), epoch, "key").alias("doc_key")]


def _placed(passes: DataFrame) -> DataFrame:
    """Units of passes with ``start``: tokens before them in their pass."""
    within = Window.partitionBy("source", "epoch", "block_key").orderBy("doc_key", "key", "tokens")
    passes = passes.withColumn("size", F.col("tokens") * F.col("copies")).withColumn("in_block", F.sum("size").over(within) - F.col("size"))
    blocks = passes.groupBy("source", "epoch", "block_key").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("source", "epoch").orderBy("block_key")) - F.col("block_size")
    blocks = blocks.select("source", "epoch", "block_key", before.alias("before"))
    return passes.join(blocks, ["source", "epoch", "block_key"]).withColumn("start", F.col("before") + F.col("in_block"))


def _fits() -> Column:
    """Whether a unit is in its pass: every one in a whole pass, the first ones of the last within its budget."""
    partial = (F.col("start") + F.col("size") <= F.col("rest")) & ((F.col("rest") > 0) | (F.col("total") == 0))
    return (F.col("epoch") < F.col("epochs")) | partial


def plan(docs: DataFrame, entropy: float = 0.97, most_epochs: float = 4.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(source, epoch, start, doc_id, tokens, weight): every drawn document at its place in its source's pass.

    ``budget`` tokens in all; None: as many as the documents have.
    """
    units = stored(_units(docs), "units")
    w = F.broadcast(weights(units, entropy, most_epochs, budget))       # at most MOST_SOURCES rows
    passes = units.join(w, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    passes = passes.withColumns(dict(zip(("block_key", "doc_key"), _order(seed, F.col("epoch")))))
    drawn = _placed(passes).filter(_fits()).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return drawn.select("source", "epoch", (F.col("start") + F.col("copy") * F.col("tokens")).alias("start"), "doc_id", "tokens", "weight")


def mixed(docs: DataFrame, entropy: float = 0.97, most_epochs: float = 4.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` as often as ``plan`` draws them. Texts are not shuffled: a source's last pass ends at a known place."""
    units = stored(_units(docs), "units")
    w = weights(units, entropy, most_epochs, budget)
    last = units.join(F.broadcast(w), "source").withColumn("epoch", F.col("epochs"))
    last = last.withColumns(dict(zip(("block_key", "doc_key"), _order(seed, F.col("epoch")))))
    place = lambda: F.struct("block_key", "doc_key", "key", "tokens")
    ends = stored(_placed(last).filter(_fits()).groupBy("source").agg(F.max(place()).alias("end")), "ends")
    names = {c: fresh(c) for c in docs.columns}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), _tokens().alias("tokens"))
    # At most MOST_SOURCES rows each.
    rows = rows.join(F.broadcast(w), "source").join(F.broadcast(ends), "source", "left")
    rows = rows.withColumns(dict(zip(("block_key", "doc_key"), _order(seed, F.col("epochs")))))
    times = F.col("epochs") + F.when(F.col("end").isNotNull() & (place() <= F.col("end")), 1).otherwise(0)
    rows = rows.withColumn("times", times.cast("int")).filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def plan_sql(entropy: float = 0.97, most_epochs: float = 4.0, seed: int = 0) -> str:
    """``plan`` with the default budget in DuckDB's SQL, over a view ``documents``."""
    draw = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
    total = lambda t: f"list_sum(list_transform(shares, lambda s: pow(s, {t})))"
    spread = lambda t: f"list_sum(list_transform(shares, lambda s: CASE WHEN pow(s, {t}) > 0 THEN pow(s, {t}) * ln(pow(s, {t})) ELSE 0 END))"
    enough = lambda t: f"(ln({total(t)}) - {spread(t)} / {total(t)} >= {entropy} * ln(len(shares)))"
    rare = lambda t: f"(pow(list_min(shares), {t}) / {total(t)} <= {most_epochs} * list_min(shares))"
    half = "(low + high) / 2"
    return f"""WITH RECURSIVE units AS (
  SELECT coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS key, doc_id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens, count(*) AS copies FROM documents GROUP BY ALL),
sources AS (SELECT source, sum(tokens * copies)::BIGINT AS total, sum(copies)::BIGINT AS n FROM units GROUP BY 1),
whole AS (SELECT sum(total)::BIGINT AS alls, list(total ORDER BY total) FILTER (total > 0) AS totals FROM sources),
shares AS (SELECT alls, list_transform(totals, lambda t: t / alls) AS shares FROM whole),
e AS (SELECT 0 AS i, shares, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM shares UNION ALL
  SELECT i + 1, shares, CASE WHEN {enough(half)} THEN {half} ELSE low END, CASE WHEN {enough(half)} THEN high ELSE {half} END FROM e WHERE i < {STEPS}),
r AS (SELECT 0 AS i, shares, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM shares UNION ALL
  SELECT i + 1, shares, CASE WHEN {rare(half)} THEN low ELSE {half} END, CASE WHEN {rare(half)} THEN {half} ELSE high END FROM r WHERE i < {STEPS}),
x AS (SELECT alls, shares.shares, round(greatest(CASE WHEN {enough('1.0').replace('shares', 'shares.shares')} THEN 1.0 ELSE e.low END,
    CASE WHEN {rare('0.0').replace('shares', 'shares.shares')} THEN 0.0 ELSE r.high END), 6) AS exponent
  FROM shares, e, r WHERE e.i = {STEPS} AND r.i = {STEPS}),
w AS (SELECT source, ceil(n / {BLOCK})::BIGINT AS n_blocks, total, weight, floor(weight * alls)::BIGINT // greatest(total, 1) AS epochs,
    floor(weight * alls)::BIGINT % greatest(total, 1) AS rest FROM (
  SELECT source, n, total, alls, round(CASE WHEN total > 0 THEN pow(total / alls, exponent) / {total('exponent')} ELSE 0 END, 9) AS weight FROM sources, x)),
passes AS (SELECT *, {draw(str(seed), 'source', 'epoch', f"{draw(str(seed), 'key')} % n_blocks")} AS block_key, {draw(str(seed), 'epoch', 'key')} AS doc_key,
    tokens * copies AS size FROM (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM units JOIN w USING (source))),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source, epoch ORDER BY block_key, doc_key, key, tokens) - size AS start FROM passes)
SELECT source, epoch, (start + copy * tokens)::BIGINT AS start, doc_id, tokens, weight FROM (
  SELECT *, unnest(range(0, copies)) AS copy FROM placed
  WHERE epoch < epochs OR start + size <= rest AND (rest > 0 OR total = 0))"""
