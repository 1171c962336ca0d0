"""Line deduplication with a deletion neighbourhood, by DataFrame functions only.

Two lines within one edit share a variant: one of them with a character deleted equals the other,
or both with the character at the same place deleted are equal. Lines are compared without white
space at their ends; a line goes if an equal line, or one within the edit bound, occurs earlier
(by document id, then line number). Whether that earlier line itself stays does not matter, so the
result needs no order of decisions.

Emitting every deletion of every line would multiply the text by its line length. Three levels
narrow it down without losing a pair, as one edit touches one part of a line only:

1. Lines are cut in two halves. A line goes on if it shares one half with another line.
2. These are cut in 16 parts. A part goes on if all the other parts equal another line's.
3. Deletions are made inside these parts, hashed as keys, and joined.

Lines that share a variant at the same place are all within one edit of each other, so the earliest
of a key is taken by aggregates, combined before the shuffle: no pairs of a group are made. The
edit distance of each line and the earliest line found for it is verified at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table

# Shorter lines are not compared by edits; exact repeats have a bound of their own (``equal_chars``).
MIN_CHARS = 20
PARTS = 16
EDITS = 1
WHITE = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line number, trimmed line, its length and digests, of the lines that count."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")
    )
    trimmed = lines.select("doc_id", "line_no", F.btrim("raw", F.lit(WHITE)).alias("line"))
    return (
        trimmed.withColumn("n", F.length("line"))
        .where(F.col("n") >= min_chars)
        .withColumn("h", F.xxhash64("line"))
        .withColumn("digest", F.unhex(F.md5("line")))
    )


def _around(line: Column, m: Column, part: Column, parts: int) -> Column:
    """Hash of all but one part of a line, as seen by lines whose shorter one has ``m`` characters."""
    start = F.floor(part * m / parts).cast("int")
    end = F.floor((part + 1) * m / parts).cast("int")
    return F.xxhash64(m, part, F.left(line, start), F.right(line, m - end))


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Keys with two different lines at least."""
    both = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return both.where(F.col("low") != F.col("high")).select("key")


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Digests of the lines that have an earlier line, not equal, within the edit bound."""
    lines = _lines(docs, min_chars)
    n = F.col("n")
    halves = [_around(F.col("line"), m, F.lit(p), 2) for m in (n, n - 1) for p in (0, 1)]
    keys = lines.select("h", F.explode(F.array(*halves)).alias("key"))
    shared = stored(_shared_keys(keys), "halves")
    some = stored(keys.join(shared, "key", "left_semi").select("h").distinct(), "candidates")
    # The earliest place of each candidate, and its text.
    candidates = stored(
        lines.join(some, "h", "left_semi")
        .groupBy("digest", "h", "line", "n")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("place")),
        "lines",
    )
    parts = candidates.select(
        "digest", "h", "line", "n", "place", F.explode(F.array(n, n - 1)).alias("m")
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parts = parts.withColumn("key", _around(F.col("line"), F.col("m"), F.col("part"), PARTS))
    open_parts = stored(_shared_keys(parts.select("key", "h")), "parts")
    start = F.floor(F.col("part") * F.col("m") / PARTS).cast("int")
    end = F.floor((F.col("part") + 1) * F.col("m") / PARTS).cast("int")
    longer = n - F.col("m")
    inner = parts.join(open_parts, "key", "left_semi").select(
        "digest", "place", "key", longer.alias("longer"),
        F.substring(F.col("line"), start + 1, end - start + longer).alias("inner"),
    )
    # Place -1 is the part as it is; the others have the character at that place deleted.
    size = F.length("inner")
    places = F.when(F.col("longer") == 0, F.array(F.lit(-1))).when(size > 0, F.sequence(F.lit(0), size - 1))
    variants = inner.withColumn("at", F.explode(places))
    variant = F.when(F.col("at") < 0, F.col("inner")).otherwise(
        F.concat(F.left("inner", F.col("at")), F.right("inner", size - F.col("at") - 1))
    )
    variants = variants.select(
        "digest", F.xxhash64("key", variant).alias("key"), "at", F.struct("place", "digest").alias("who")
    )
    first = variants.groupBy("key", "at").agg(F.min("who").alias("first"))
    first = stored(first, "first")
    by_key = first.groupBy("key").agg(
        F.min(F.when(F.col("at") < 0, F.col("first"))).alias("whole"),
        F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("deleted"),
        F.count(F.lit(1)).alias("rows"),
    )
    by_key = stored(by_key, "keys")
    found = (
        variants.join(first, ["key", "at"])
        .join(by_key, "key")
        .select(
            "digest",
            "who",
            F.when(F.col("at") < 0, F.col("deleted")).otherwise(F.least("first", "whole")).alias("earliest"),
        )
        .where(F.col("earliest") < F.col("who"))
        .groupBy("digest")
        .agg(F.min("earliest").alias("earliest"))
        .select("digest", F.col("earliest.digest").alias("other"))
    )
    left = candidates.select("digest", F.col("line").alias("a"))
    right = candidates.select(F.col("digest").alias("other"), F.col("line").alias("b"))
    close = F.levenshtein("a", "b", EDITS)  # -1 beyond the bound
    return found.join(left, "digest").join(right, "other").where(close.between(0, EDITS)).select("digest")


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, result_col: str = "text",
    equal_chars: int | None = None,
) -> DataFrame:
    """``docs`` with a struct ``result_col``: text without repeated lines, n_lines, n_dropped.

    Lines of ``min_chars`` go if an earlier one is within the edit bound, those of ``equal_chars`` if an
    earlier one is equal (1: every line that is not empty; by default ``min_chars``, as in the SQL check).

    Lines end at a line feed. Rows stay, also when all their lines go; a null text stays null.
    Rows without an id are left as they are. Rows that repeat an id count as one document, whose
    lines have the numbers they have in each row. A column named ``result_col`` is replaced.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    least = min_chars if equal_chars is None else min(equal_chars, min_chars)
    lines = _lines(rows, least)
    firsts = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("place"))
    near = stored(near_lines(rows, min_chars), "near")
    kept = firsts.join(near, "digest", "left_anti").select("place.*")
    # The kept lines of a document as bits, 32 lines a word.
    words = kept.groupBy("doc_id", F.expr("line_no div 32").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, line_no % 32)")).alias("bits")
    )
    bits = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    bits = bits.select(F.col("doc_id").alias("_line_doc"), F.col("bits").alias("_line_bits"))
    joined = docs.join(bits, named(id_col).cast("long") == F.col("_line_doc"), "left")
    split = F.split(named(text_col).cast("string"), "\n", -1)
    dense = F.transform(
        F.sequence(F.lit(0), F.expr("size(_line_split) div 32")),
        lambda w: F.coalesce(F.element_at(F.col("_line_bits"), w.cast("int")), F.lit(0).cast("long")),
    )
    joined = joined.withColumn("_line_split", split).withColumn("_line_dense", dense)

    def stays(line, i):
        word = F.element_at(F.col("_line_dense"), (F.floor(i / 32) + 1).cast("int"))
        bit = F.call_function("shiftright", word, (i % 32).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        return (F.length(F.btrim(line, F.lit(WHITE))) < least) | bit

    remaining = F.when(named(id_col).isNull(), F.col("_line_split")).otherwise(F.filter("_line_split", stays))
    joined = joined.withColumn("_line_left", remaining)
    result = F.struct(
        F.array_join("_line_left", "\n").alias("text"),
        F.coalesce(F.size("_line_split"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_line_split") - F.size("_line_left"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return joined.withColumn(result_col, result).drop(
        "_line_doc", "_line_bits", "_line_split", "_line_dense", "_line_left"
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("r")
    return deduplicate_lines(docs, result_col="r").select(
        "doc_id",
        r["n_lines"].alias("n_lines"),
        r["n_dropped"].alias("n_dropped"),
        F.sha2(F.coalesce(r["text"], F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
