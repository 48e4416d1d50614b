"""Personal data in whole texts: exact base patterns, and candidates chosen by gradient boosted trees.

Base spans (email, ip, card, phone) are leftmost matches that do not overlap within a kind; those that fail the kind's
test are dropped. Candidate generators then propose wider, overlapping spans: obfuscated addresses, numbers with other
separators or without prefix. Boosted trees judge their format and context. Chosen candidates that touch neither base spans
nor a surer candidate are added.

The trees are fitted on at most ``most_labelled`` candidates (by hash of doc_id), half of them from as many rewritings. What is personal is taught by the base
spans of the sample, rewritten in their own places as people disguise them (``_forms``): a candidate that covers such a
rewriting is personal, one that covers it badly isn't. Not personal are also decoys (a number that fails its test, words
around " at ", lists of numbers) and what the generators find in the prose outside base spans, unless it looks disguised
itself (``_unsure``): that has no label and is left out. A quarter of the documents is held out to calibrate one threshold
for each kind, halfway between the lowest with the wanted precision and the next held-out candidate below it (or 0.5).

All of it is column expressions: the fitted trees become nested CASE expressions on the candidates' fields, and a
document's spans never leave its row, so nothing is shuffled but the bounded sample.

Places are found from the texts between matches: the pieces that ``split`` leaves and the matches add up to the text.
Patterns are possessive and start only where a run of their characters starts (or the last match ended), which gives
the same matches without quadratic scans of long runs.

Defined results: null text is empty; an empty text has no spans; repeated rows are treated each for itself; an empty table
gives no rows, and without candidates of both sorts no spans are added. Other columns are passed on, clashing names
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, seeded, stored

# The kinds in their order, and the base patterns with the same matches as the plain ones in the comments.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that let most texts pass the patterns by.
SIGNS = {"email": "@", "phone": "+"}
GENERATORS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?"
              r"[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++"),
    # The same without blanks around a plain dot, which mostly end a sentence.
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?"
              r"[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:\x20?[\[(]?[.,][\])]?\x20?[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){11,18}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"\(?(?<![0-9])[0-9]{3}\)?[\x20./-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: What every match of a kind's generators holds; most texts are passed by for want of it.
HINTS = {
    "email": r"(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)",
    "ip": r"[0-9](?:\x20?[\[(]?[.,][\])]?\x20?[0-9]{1,3}+){3}", "card": r"[0-9](?:[\x20./_-]?[0-9]){11}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}",
}
SPAN = "array<struct<begin:int,kind:int,end:int>>"
FEATURES = ("length", "digits", "groups", "longest_group", "letters", "spaces", "dots", "hyphens", "brackets", "plus", "large_part",
            "check_digit", "before_digit", "before_letter", "after_letter", "after_digit", "before_hint", "marks", "at_sign", "sentence",
            "last_letters", "is_email", "is_ip", "is_card")
#: Characters of a document kept on each side of a rewritten span.
AROUND = 40


def _places(text: Column, pattern: str) -> Column:
    """array<struct<begin, found>> of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("found"), F.length(g).alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,found:string>>").alias("out"))
    walked = F.aggregate(
        paired, empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["found"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("begin"), x["found"].alias("found")))).alias("out")))
    return walked["out"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    digits = F.split(F.reverse(_digits(s)), "")
    value = lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))
    return F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _parts_fit(s: Column) -> Column:
    """Every run of digits is a number of at most 255, however many zeros it starts with."""
    runs = F.filter(F.split(s, "[^0-9]+"), lambda p: p != "")
    return F.forall(F.transform(runs, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


TESTS = {
    "email": lambda s: F.lit(True), "ip": _parts_fit, "card": _luhn,
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<begin, kind, end>> in order of begin, then kind."""
    per_kind = []
    for k, kind in enumerate(KINDS):
        test = TESTS[kind]
        spans = F.transform(
            F.filter(_places(text, BASE[kind]), lambda x: test(x["found"])),
            lambda x: F.struct(x["begin"].alias("begin"), F.lit(k).alias("kind"), (x["begin"] + F.length(x["found"])).alias("end")))
        passes = F.contains(text, F.lit(SIGNS[kind])) if kind in SIGNS else text.rlike(BASE[kind])
        per_kind.append(F.when(passes, spans.cast(SPAN)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*per_kind))


def _fields(text: Column, x: Column) -> Column:
    """A candidate with its features, all doubles."""
    s, begin, kind = x["found"], x["begin"], x["kind"]
    end = begin + F.length(s)
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    before, after = F.substring(text, F.greatest(begin - 1, F.lit(1)), F.least(begin, F.lit(2))), F.substring(text, end + 1, F.lit(2))
    start = F.greatest(begin - 12, F.lit(0))
    context = F.lower(F.substring(text, start + 1, begin - start))
    count = lambda chars: F.length(s) - F.length(F.regexp_replace(s, chars, ""))
    values = {
        "length": F.length(s), "digits": F.length(_digits(s)), "groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "letters": count("[A-Za-z]"),
        "spaces": count(" "), "dots": count("[.]"), "hyphens": count("[-_/]"), "brackets": count("[()\\[\\]]"),
        "plus": s.startswith("+"), "large_part": ~_parts_fit(s), "check_digit": _luhn(s),
        "before_digit": before.rlike("[0-9.,-]$|[0-9] $"), "before_letter": before.rlike("[A-Za-z_=\"]$"), "after_letter": after.rlike("^[A-Za-z0-9_]"), "after_digit": after.rlike("^[.,/-]?[0-9]"),
        "before_hint": context.rlike("tel|phone|call|fax|mail|card|host|addr|ip|contact"),
        "marks": count("[\\[(](?:at|dot|[.])[)\\]]|(?<= )dot(?= )"), "at_sign": s.contains("@"), "sentence": count("[.,](?= )"),
        "last_letters": F.length(F.regexp_extract(s, "[A-Za-z]*$", 0)),
        "is_email": kind == 0, "is_ip": kind == 1, "is_card": kind == 2,
    }
    return F.struct(begin.alias("begin"), kind.alias("kind"), end.alias("end"), *[values[f].cast("double").alias(f) for f in FEATURES])


def candidates(text: Column) -> Column:
    """What the generators propose, overlapping spans included, with features."""
    place = "array<struct<begin:int,kind:int,found:string>>"
    per_generator = []
    for kind, pattern in GENERATORS:
        found = F.transform(_places(text, pattern), lambda x: F.struct(x["begin"].alias("begin"), F.lit(KINDS.index(kind)).alias("kind"), x["found"].alias("found")))
        per_generator.append(F.when(text.rlike(HINTS[kind]), found.cast(place)).otherwise(F.array().cast(place)))
    return F.transform(F.concat(*per_generator), lambda x: _fields(text, x))


def _overlap(a: Column, b: Column) -> Column:
    return F.least(a["end"], b["end"]) - F.greatest(a["begin"], b["begin"])


def _forms(kind: int, s: Column, before: Column, after: Column) -> list[tuple[Column, bool]]:
    """A base span as people disguise it, and decoys in its place (True); null where a form has no sense."""
    swap = lambda x, pattern, by: F.regexp_replace(x, pattern, by)
    digits = _digits(s)
    if kind == 0:
        name, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        # Once as it is and once without digits, so that digits alone decide nothing.
        bare = lambda x: F.coalesce(F.nullif(swap(x, "[0-9]+", ""), F.lit("")), x)
        put = lambda at, dot: [(F.concat(n, F.lit(at), swap(d, "[.]", dot)), False) for n, d in ((name, domain), (bare(name), bare(domain)))]
        word = lambda x, pattern, i: F.coalesce(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")), F.lit("them"))
        last = word(before, "([A-Za-z]+)[^A-Za-z]*$", 1)
        next_, third = (word(after, "([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)", i) for i in (1, 2))
        time = F.concat((F.length(s) % 24).cast("string"), F.lit("."), (10 + F.length(s) % 50).cast("string"))
        disguised = [form for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at ", " dot "), (" at ", "."), (" @ ", ".")) for form in put(at, dot)]
        prose = [F.concat(w, F.lit(" at "), rest) for w in (last, name) for rest in (
            F.concat(next_, F.lit(". "), F.initcap(third)), F.concat(next_, F.lit(". "), third), time)]
        return disguised + [(p, True) for p in prose]
    if kind == 1:
        large = F.concat(F.lit("7"), F.lpad(F.substring_index(s, ".", 1), 2, "4"), F.lit("."), F.substring_index(s, ".", -3))
        return [(swap(s, "[.]", "[.]"), False), (swap(s, "[.]", "(.)"), False), (swap(s, "[.]", " . "), False),
                (swap(s, "[.]", ", "), True), (swap(s, "[.]", ","), True), (swap(large, "[.]", "[.]"), True), (swap(large, "[.]", " . "), True)]
    if kind == 2:
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.translate(F.substring(digits, -1, 1), "0123456789", "1234567890"))
        fours = lambda x, by: swap(x, "([0-9]{4})(?=[0-9])", f"$1{by}")
        return [*[(fours(digits, by), False) for by in "./_"], *[(fours(wrong, by), True) for by in "./_-"], (wrong, True)]
    tail = F.when(F.length(digits) >= 10, F.substring(digits, -10, 10))
    put = lambda form: swap(tail, "([0-9]{3})([0-9]{3})([0-9]{4})", form)
    return [(put("($1) $2-$3"), False), (put("$1-$2-$3"), False), (put("$1.$2.$3"), False), (put("1 $1 $2 $3"), False), (put("00 $1 $2 $3"), False),
            (put("7-$1-$2-$3-5"), True), (put("$1.$2.$3.12"), True), (put("3,$1 $2 $3,8"), True)]


def _unsure(c: Column) -> Column:
    """A candidate outside base spans that prose doesn't hold by chance: disguised, or with a right check digit."""
    phone = c["kind"] == KINDS.index("phone")
    card = (c["kind"] == KINDS.index("card")) & (c["check_digit"] == 1)
    return phone | card | (c["marks"] > 0)


@dataclass
class Model:
    trees: list[tuple[float, tuple]]        # weight, (feature, threshold, left, right) or (value,)
    thresholds: list[float]                 # by kind; over 1: nothing is added

    def probability(self, c: Column) -> Column:
        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            return F.when(c[FEATURES[node[0]]] <= F.lit(float(node[1])), walk(node[2])).otherwise(walk(node[3]))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(float(weight)) * walk(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _grown(node) -> tuple:
    if node.numDescendants() == 0 if hasattr(node, "numDescendants") else False:
        return (node.prediction(),)
    if node.getClass().getSimpleName() == "LeafNode":
        return (node.prediction(),)
    return (node.split().featureIndex(), node.split().threshold(), _grown(node.leftChild()), _grown(node.rightChild()))


def _rewritten(found: DataFrame, most: int) -> DataFrame:
    """(held, drawn, label, c): what the generators find where a base span of ``found`` stands in another form, of which
    ``most`` are drawn by hash before the generators run."""
    spans = found.select("held", "drawn", "text", F.explode("base").alias("b"))
    begin = F.greatest(F.col("b.begin") - AROUND, F.lit(0))
    spans = spans.select("held", "drawn", F.col("b.kind").alias("kind"), F.substring("text", F.col("b.begin") + 1, F.col("b.end") - F.col("b.begin")).alias("s"),
                         F.substring("text", begin + 1, F.col("b.begin") - begin).alias("before"), F.substring("text", F.col("b.end") + 1, F.lit(AROUND)).alias("after"))
    forms = F.array().cast("array<struct<form:string,decoy:boolean>>")
    for k in range(len(KINDS)):
        of_kind = [F.struct(form.alias("form"), F.lit(decoy).alias("decoy")) for form, decoy in _forms(k, F.col("s"), F.col("before"), F.col("after"))]
        forms = F.when(F.col("kind") == k, F.array(*of_kind)).otherwise(forms)
    placed = spans.select("held", "drawn", "kind", "before", "after", F.explode(forms).alias("f")).filter("f.form is not null")
    placed = placed.select("held", F.xxhash64("drawn", "f.form").alias("drawn"), "kind", "f.decoy", F.concat("before", "f.form", "after").alias("text"), F.struct(
        F.length("before").alias("begin"), (F.length("before") + F.length("f.form")).alias("end")).alias("place")).orderBy("drawn", "text").limit(most)
    seen = placed.select("*", F.explode(candidates(F.col("text"))).alias("c")).filter(_overlap(F.col("place"), F.col("c")) > 0)
    span = F.greatest("place.end", "c.end") - F.least("place.begin", "c.begin")
    covers = (F.col("kind") == F.col("c.kind")) & (_overlap(F.col("place"), F.col("c")) >= 0.9 * span)
    return seen.select("held", "drawn", (covers & ~F.col("decoy")).cast("double").alias("label"), "c")


def fit(docs: DataFrame, most_labelled: int = 4000, rounds: int = 10, depth: int = 4, precision: float = 0.98, seed: int = 0) -> Model:
    """Trees and thresholds from the documents' own base spans in other forms; at most ``most_labelled`` candidates are
    looked at, half of them from prose."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    text = F.coalesce("text", F.lit(""))
    likely = text.rlike("[0-9]{3}|@|[\\[(]at[\\])]")
    # Where the sample ends is found from hashes alone, so that no task gathers texts.
    key = seeded(seed, F.col("doc_id"))
    end = docs.filter(likely).select(key.alias("key")).orderBy("key").limit(most_labelled).agg(F.max("key")).first()[0]
    sampled = stored(docs.filter((key <= F.lit(end)) & likely).select("doc_id", text.alias("text")), "sample")
    held = F.pmod(seeded(seed + 1, F.col("doc_id")), F.lit(4)) == 0
    bounded = lambda df: df.select("label", "held", "c.*", F.xxhash64("drawn", "c.begin", "c.end", "c.kind").alias("drawn")).orderBy("drawn").limit(most_labelled // 2)
    found = sampled.select(held.alias("held"), seeded(seed + 2, F.col("doc_id")).alias("drawn"), "text", base_spans(F.col("text")).alias("base"))
    prose = (found.select("held", "drawn", "base", F.explode(candidates(F.col("text"))).alias("c")).withColumn("label", F.lit(0.0))
             .filter(~F.exists("base", lambda b: _overlap(b, F.col("c")) > 0) & ~_unsure(F.col("c"))))
    rows = stored(bounded(prose).unionByName(bounded(_rewritten(found, most_labelled // 2))), "candidates")
    sides = {r.label: r["count"] for r in rows.filter("not held").groupBy("label").count().collect()}
    if len(sides) < 2:
        return Model([], [2.0] * len(KINDS))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    train = vector.transform(rows.filter("not held")).select("vector", "label").coalesce(1).persist()
    booster = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.5, seed=seed).fit(train)
    train.unpersist()
    trees = [(w, _grown(t._call_java("rootNode"))) for w, t in zip(booster.treeWeights, booster.trees)]
    model = Model(trees, [2.0] * len(KINDS))
    scored = (rows.filter("held").withColumn("c", F.struct(*FEATURES)).select("kind", "label", F.floor(100 * model.probability(F.col("c"))).alias("p"))
              .groupBy("kind", "p").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect())    # at most 101 rows for each kind
    for k in range(len(KINDS)):
        right = n = 0
        falling = sorted((r for r in scored if r.kind == k), key=lambda r: -r.p)
        for r, below in zip(falling, [r.p for r in falling[1:]] + [0]):
            right, n = right + r.right, n + r.n
            if r.p >= 50 and right >= precision * n:
                model.thresholds[k] = (r.p + max(below, 50)) / 200
    return model


def find_spans(docs: DataFrame, model: Model, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with columns ``base`` and ``spans`` (base and added), each array<struct<begin, kind, end>> in order."""
    text = fresh("text")
    out = docs.drop(base, spans).withColumn(text, F.coalesce("text", F.lit("")))
    out = out.withColumn(base, base_spans(F.col(text)))
    if not model.trees:
        return out.withColumn(spans, F.col(base)).drop(text)
    limit = F.array(*[F.lit(t) for t in model.thresholds])
    free = F.filter(candidates(F.col(text)), lambda c: ~F.exists(F.col(base), lambda b: _overlap(b, c) > 0))
    judged = F.transform(free, lambda c: F.struct(
        (-model.probability(c)).alias("p"), c["begin"].alias("begin"), c["kind"].alias("kind"), c["end"].alias("end")))
    chosen = F.array_sort(F.filter(judged, lambda c: -c["p"] >= F.element_at(limit, c["kind"] + 1)))
    added = F.aggregate(chosen, F.array().cast(SPAN), lambda acc, c: F.when(F.exists(acc, lambda a: _overlap(a, c) > 0), acc).otherwise(
        F.concat(acc, F.array(F.struct(c["begin"], c["kind"], c["end"])).cast(SPAN))))
    return out.withColumn(spans, F.array_sort(F.concat(base, added))).drop(text)


def joined(spans: Column) -> Column:
    """kind:begin:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` whose texts have each run of overlapping spans replaced by the name of its first kind in brackets."""
    base, found = fresh("base"), fresh("spans")
    spans = find_spans(docs, model, base, found)
    merged = F.aggregate(found, F.array().cast(SPAN), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["begin"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["begin"].alias("begin"), F.element_at(acc, -1)["kind"].alias("kind"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    m = fresh("merged")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    end_of = lambda i: F.when(i == 0, 0).otherwise(F.element_at(F.col(m), F.greatest(i, F.lit(1)))["end"])
    parts = F.transform(F.col(m), lambda s, i: F.concat(
        F.substring(F.col("text"), end_of(i) + 1, s["begin"] - end_of(i)), F.element_at(names, s["kind"] + 1)))
    tail = F.substring(F.col("text"), F.element_at(F.col(m), -1)["end"] + 1, F.length("text"))
    text = F.when(F.size(m) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    return spans.withColumn(m, merged).withColumn("text", text).select(docs.columns)
