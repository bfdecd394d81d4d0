"""Personal data by patterns, extended by bootstrapped contextual extraction.

Seeds are the spans of the base patterns (e-mail, IP, card, phone). Each mention in the corpus, a seed or any other
token with a digit or an at sign, stands between contexts: the nearest one, two and three words to its left and to its right, with the punctuation
in between where it stands alone (``email =``). Contexts and values form a bipartite graph. Round by round a context's score for a kind is the
confidence of its distinct values in that kind over their number, where values of no kind count half (they may be unseen identifiers); contexts with enough distinct values behind a high score are patterns, and a
value's confidence is that of its best pattern on each side, taken together (the contexts of one side contain one another, so
only the best counts). Values of high confidence are unseen identifiers: their mentions are added to the base spans, and they are
seeds of the next round.

All of it is DataFrame functions; contexts and values are counted with partial aggregation, so a context as
frequent as "the" costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .spans import left_contexts, right_contexts, spans

#: In the order of the digest.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, possessive and anchored at the start of a run, which finds the same and takes linear time. Cards are
#: matched as whole runs of 13 to 19 digits only; other runs fail anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Other tokens that may be identifiers: a digit or at sign among word characters.
TOKEN = r"(?<![A-Za-z0-9@._%+/:#-])(?=[A-Za-z._%+/:#-]*+[0-9@])[A-Za-z0-9@][A-Za-z0-9@._%+/:#-]*+"

ROUNDS = 3
#: A pattern's least score and least sum of its distinct values' confidences.
PATTERN_SCORE, PATTERN_SUPPORT = 0.8, 5.0
#: What a distinct value of no kind counts against a pattern.
UNTYPED = 0.5
#: A value's least confidence.
CONFIDENT = 0.9


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """Matches as array<struct<start,end,value,left,right>>; left and right are the contexts."""
    return F.transform(spans(text, pattern, hint), lambda s: F.struct(s["start"], s["end"], s["value"], left_contexts(s["before"]).alias("left"), right_contexts(s["after"]).alias("right")))


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        number = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(number(p)) <= 3, number(p)), F.lit("999")), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)  # noqa: E731  doubled at even places from the right
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: (acc + digit(i) - F.when(digit(i) > 9, 9).otherwise(0)).cast("int"))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _holding(kind: str):
    return lambda s: _holds(kind, s["value"])


def _as_mention(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))


def find_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's text), an array per base kind, and ``tokens`` that overlap no base span, of every whole text."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("__text"))
    for kind in KINDS:
        found = found.withColumn(kind, F.filter(_spans(F.col("__text"), PATTERNS[kind], HINTS[kind]), _holding(kind)))
    trimmed = F.transform(
        _spans(F.col("__text"), TOKEN, "[0-9@]"),
        lambda s: s.withField("value", F.rtrim(s["value"], F.lit("._%+/:#-"))).withField("end", (s["start"] + F.length(F.rtrim(s["value"], F.lit("._%+/:#-")))).cast("int")),
    )
    likely = lambda s: (F.length(s["value"]) >= 5) & F.regexp_like(s["value"], F.lit("@|(?:[0-9].*){4}"))
    # Written before the arrays are compared: else the optimiser moves the patterns into the comparison of every pair.
    found = materialise(found.withColumn("tokens", F.filter(trimmed, likely)).drop("__text"), "pii-mentions")
    base = F.concat(*KINDS)
    return found.withColumn("tokens", F.filter("tokens", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def discover(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of identifiers that are no seeds, by scoring the graph of contexts and values."""
    seeds = mentions.select(F.explode(F.concat(*(F.transform(k, _as_mention(k)) for k in KINDS))).alias("m")).select("m.*")
    others = mentions.select(F.explode("tokens").alias("m")).select(F.lit(None).cast("string").alias("kind"), F.col("m.value").alias("value"), F.col("m.left").alias("left"), F.col("m.right").alias("right"))
    marked = lambda mark, side: F.transform(side, lambda c: F.concat(F.lit(mark), c))
    sides = F.concat(marked("< ", "left"), marked("> ", "right"))
    edges = materialise(seeds.unionByName(others).select("kind", "value", F.explode(sides).alias("context")).distinct(), "pii-edges")
    sizes = edges.groupBy("context").agg(F.count_distinct("value").alias("n"))
    graph = edges.select("context", "value").distinct()
    known = edges.where("kind is not null").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    trusted, found = known, None
    for k in range(rounds):
        of_kind = [F.sum(F.when(F.col("kind") == k, F.col("confidence")).otherwise(0.0)).alias(k) for k in KINDS]
        weight = graph.join(trusted, "value").groupBy("context").agg(F.sum("confidence").alias("typed"), *of_kind)
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("weight")) for k in KINDS))).alias("w")
        weight = weight.select("context", "typed", each).select("context", "typed", "w.*").where(F.col("weight") >= PATTERN_SUPPORT)
        patterns = weight.join(sizes, "context").withColumn("score", F.least(F.lit(0.999), F.col("weight") / (F.col("typed") + F.greatest(F.lit(0.0), F.col("n") - F.col("typed")) * UNTYPED)))
        patterns = patterns.where(F.col("score") >= PATTERN_SCORE).select("context", "kind", "score")
        side = lambda mark: F.coalesce(F.max(F.when(F.col("context").startswith(mark), F.col("score"))), F.lit(0.0))
        reached = graph.join(patterns, "context").groupBy("value", "kind").agg((1 - (1 - side("<")) * (1 - side(">"))).alias("confidence"))
        fresh = reached.join(known.select("value").distinct(), "value", "left_anti").where(F.col("confidence") >= CONFIDENT)
        best = fresh.groupBy("value").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("b"))  # one kind for a value
        found = materialise(best.select("value", "b.kind", "b.confidence"), f"pii-round{k}")
        trusted = known.unionByName(found)
    return found


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id with ``base`` and ``added``, arrays of (kind, start, end), for every row of docs (doc_id, text).

    A null text is empty and has no spans. Repeated rows get the same answer each; rows without an id are read like
    others; extra columns are ignored; an empty table gives an empty one. Added spans never overlap base ones.
    """
    mentions = find_mentions(docs)
    values = discover(mentions, rounds)
    place = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    tokens = mentions.select("doc_id", "key", F.explode("tokens").alias("t"))
    added = (
        tokens.join(values, tokens.t.value == values.value)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("kind", F.col("t.start").alias("start"), F.col("t.end").alias("end"))).alias("added"))
        .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "added")
    )
    joined = mentions.join(added, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return joined.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*(F.transform(k, place(k)) for k in KINDS)).alias("base"), F.coalesce("added", none).alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed and then start."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
