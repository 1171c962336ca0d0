"""Personal data: base patterns, and bootstrapped contexts that find further identifiers.

Only DataFrame functions run here. The base finds emails, IP addresses, payment cards and phone
numbers by regular expressions. They are the seeds of a bootstrap: the word before a mention is a
lexical pattern, the mention an instance, and both form a graph. In each round a pattern is scored
by the share of its distinct instances that are known to be of one kind, and an instance that only
a trusted pattern knows becomes known, until a round learns nothing. Patterns trusted in the end mark the unseen identifiers in
their places. Patterns and instances are aggregates, combined before the shuffle; no group is
gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table

# Kinds in their order and their patterns, written so that a long run of characters
# is walked once (a match begins where a run begins or where the last match ended, and nothing is
# given back that could not lead to a match).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without this has no match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Tokens that look like an identifier: at least six characters and three digits, or an @.
MENTION = r"(?<!\S)(?=\S{6})(?:(?=\S*@\S)|(?=(?:[^\s0-9]*[0-9]){3}))\S+"
# A pattern is trusted from this share of known instances, and this many of them, on.
CONFIDENCE = 0.8
SUPPORT = 5
CONTEXT = 60
MAX_WORD = 40


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, in code points: the lengths of the matches and
    of what lies between them add up to the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))
    )
    return F.aggregate(pairs, begin, add, lambda state: state["out"])


NO_SPANS = "array<struct<kind:int,start:int,end:int,match:string>>"


def _spans_of(text: Column, number: int, kind: str) -> Column:
    valid_spans = F.filter(places(text, PATTERNS[kind]), lambda s: valid(kind, s["match"]))
    return F.transform(
        valid_spans,
        lambda s: F.struct(
            F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")
        ),
    )


def base_spans(text: Column) -> Column:
    """All valid base matches: (kind, start, end, match), by kind, then start."""
    parts = []
    for number, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike("[0-9]{4}|[0-9][ -][0-9]")
        some = F.when(hint & text.rlike(PATTERNS[kind]), _spans_of(text, number, kind))
        parts.append(some.otherwise(F.array().cast(NO_SPANS)))
    return F.concat(*parts)


def word_before(text: Column, start: Column) -> Column:
    """The word that ends before ``start``: lower case, the last ``MAX_WORD`` characters of it."""
    size = F.least(start, F.lit(CONTEXT))
    before = F.rtrim(F.translate(F.substring(text, start - size + 1, size), "\n\t\r\x0b\f", "     "))
    return F.lower(F.right(F.substring_index(before, " ", -1), F.lit(MAX_WORD)))


def mentions(text: Column, base: Column) -> Column:
    """Identifier-shaped tokens that touch no base span: (kind null, start, end, match)."""
    tokens = F.filter(
        places(text, MENTION),
        lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    return F.when(text.rlike(MENTION), tokens).otherwise(
        F.array().cast("array<struct<start:int,end:int,match:string>>")
    )


def trusted_patterns(edges: DataFrame, confidence: float, support: int) -> DataFrame:
    """Patterns (``word``, ``kind``) that the rounds end with. ``edges``: word, instance, kind (null
    if unknown), each once. Known instances only grow, so the rounds end; the last one scores with all of them."""
    known = stored(edges.where(F.col("kind").isNotNull()).groupBy("instance").agg(F.min("kind").alias("kind")), "known")
    graph = stored(edges.select("word", "instance").distinct(), "graph")
    while True:
        scored = graph.join(known, "instance", "left").groupBy("word", "kind").agg(F.count(F.lit(1)).alias("n"))
        scored = stored(scored, "scored")
        totals = scored.groupBy("word").agg(F.sum("n").alias("total"))
        trusted = stored(
            scored.where(F.col("kind").isNotNull() & (F.col("n") >= support))
            .join(totals, "word")
            .where(F.col("n") >= confidence * F.col("total"))
            .select("word", "kind"),
            "trusted",
        )
        learnt = graph.join(trusted, "word").groupBy("instance").agg(F.min("kind").alias("kind"))
        learnt = learnt.join(known, "instance", "left_anti")
        if learnt.isEmpty():
            return trusted
        known = stored(known.unionByName(learnt), "known")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    confidence: float = CONFIDENCE, support: int = SUPPORT,
) -> DataFrame:
    """A line per row of ``docs``: doc_id, base and found, arrays of (kind, start, end) by kind and
    start; kinds are places in ``KINDS``, ends are exclusive, places count code points.

    ``found`` holds the base and what trusted contexts add. A null text is empty. Rows that repeat
    both id and text get the same spans; ids may be null.
    """
    rows = docs.select(
        named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text")
    )
    text = F.col("text")
    spans = rows.select("doc_id", "text", F.xxhash64("text").alias("row"), base_spans(text).alias("base"))
    spans = spans.select("doc_id", "text", "row", "base", mentions(text, F.col("base")).alias("other"))

    def with_word(kind) -> callable:
        return lambda s: F.struct(
            kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.lower(s["match"]).alias("instance"), word_before(text, s["start"]).alias("word"),
        )

    seen = stored(
        spans.select(
            "doc_id",
            "row",
            F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"),
            F.transform("base", with_word(lambda s: s["kind"])).alias("seeds"),
            F.transform("other", with_word(lambda s: F.lit(None).cast("int"))).alias("other"),
        ),
        "mentions",
    )
    every = seen.select("doc_id", "row", F.explode(F.concat("seeds", "other")).alias("m")).select("doc_id", "row", "m.*")
    edges = every.where(F.col("word") != "").select("word", "instance", "kind").distinct()
    trusted = trusted_patterns(stored(edges, "edges"), confidence, support)
    added = (
        seen.select("doc_id", "row", F.explode("other").alias("m"))
        .select("doc_id", "row", "m.word", "m.start", "m.end")
        .join(trusted, "word")
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
        .select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "added")
    )
    same = seen["doc_id"].eqNullSafe(added["id"]) & (seen["row"] == added["of"])
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return seen.join(added, same, "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("found")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
