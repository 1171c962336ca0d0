"""Near-duplicates by HyperMinHash: banded compressed registers, estimates, exact verification.

A document is the set of its word 5-shingles. Each of 128 buckets keeps the least hash of the set
under a mixing of its own, compressed to the count of its leading zeros and the ten bits after
them. Documents with equal sets become one class first. Classes that agree on one of 32 bands of
four registers are candidates; the share of equal registers, corrected for registers that agree by
chance, estimates the similarity, and what may reach the bound is verified on the full sets.

Bands can hold very many near copies. A first pass verifies every class against the ends of its
bands only (two pairs a class at most), which joins almost all of them. A second pass compares, in
blocks of bounded size, just the members of a band that are still in different components. Texts come
with the members, so that a block verifies its candidates itself and gives out links that join
components, fewer than it has members: no link between components is lost and no group is spread out
into rows of pairs.

A link at the bound of 0.85 shares no band with a probability of 6e-11, and its estimate lies below
the margin of six standard deviations with one of 4e-8; at the pipeline's bound of 0.80 these are 5e-8
and 3e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import id_and_text, stored, table
from lakeops.llm.components import components
from lakeops.operators.numbering import number_rows

SHINGLE = 5
BANDS, ROWS = 32, 4
BUCKETS = BANDS * ROWS
MANTISSA = 10
# A link has at least this share of its union in common, in hundredths.
PERCENT = 85
# Standard deviations below the bound down to which estimates are verified.
MARGIN = 6
# Members of a band that are compared with each other in one piece, and bytes of their texts.
BLOCK = 1000
BLOCK_BYTES = 32 << 20
# Words whose hashes a task remembers.
MAX_WORDS = 500_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = np.random.default_rng(20240501).integers(1, 2**63, (2, BUCKETS), dtype=np.uint64)
FACTORS, OFFSETS = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1] * np.uint64(2)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 bytes.

    Words are what ASCII white space separates, A-Z in lower case. Fewer words than ``size`` are
    one shingle; no words give none.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros (six bits) and mantissa (ten) of the least mixed hash of each bucket."""
    least = np.full(BUCKETS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(values), 1024):
        mixed = values[i : i + 1024, None] * FACTORS + OFFSETS
        np.minimum(least, mixed.min(axis=0), out=least)
    top = least >> np.uint64(11)  # 53 bits, exact as a float
    zeros = (53 - np.frexp(top.astype(np.float64))[1]).astype(np.uint64)
    rest = (top << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(53 - MANTISSA))).astype("<u2")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets of these sizes agrees."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    total = np.zeros(np.broadcast(n, m).shape)
    for octave in range(54):
        high, low = 2.0**-octave, 2.0 ** -(octave + 1)
        width = low / (1 << MANTISSA)
        total += n * m * width / (n + m) * (np.exp(-(n + m) * low) - np.exp(-(n + m) * high))
    return total


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for chance."""
    p = chance(n, m)
    return (equal / BUCKETS - p) / (1 - p)


def may_link(equal, n, m, percent: int = PERCENT):
    """Whether sizes and estimate allow a link."""
    bound = percent / 100
    least = bound - MARGIN * (bound * (1 - bound) / BUCKETS) ** 0.5
    n, m = np.broadcast_to(n, np.shape(equal)), np.broadcast_to(m, np.shape(equal))
    # The correction only lowers an estimate.
    links = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (equal >= BUCKETS * least - 1e-6)
    links[links] = estimate(equal[links], n[links], m[links]) >= least
    return links


def sketch_column(text, size: int = SHINGLE):
    """Struct of a text: n_shingles, set_id (a digest of the set) and registers (null for the empty set)."""
    kind = pa.struct([("n_shingles", pa.int64()), ("set_id", pa.binary()), ("registers", pa.binary())])

    def sketch(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in texts:
            out = []
            for t in batch.cast(pa.binary()):
                found = shingles(t.as_py() or b"", hashes, size)
                some = len(found) > 0
                out.append(
                    {
                        "n_shingles": len(found),
                        "set_id": hashlib.blake2b(found.tobytes(), digest_size=16).digest() if some else None,
                        "registers": registers(found).tobytes() if some else None,
                    }
                )
            yield pa.array(out, kind)

    sketch.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(sketch, "n_shingles long, set_id binary, registers binary")(text)


def _equal_registers(a: pa.Array, b: pa.Array) -> np.ndarray:
    left, right = (
        np.frombuffer(b"".join(x.to_pylist()), dtype="<u2").reshape(-1, BUCKETS) for x in (a, b)
    )
    return (left == right).sum(axis=1)


def _candidate(percent: int):
    def candidate(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array(may_link(_equal_registers(a, b), n.to_numpy(), m.to_numpy(), percent))

    candidate.__annotations__ = {**dict.fromkeys("abnm", pa.Array), "return": pa.Array}
    return F.arrow_udf(candidate, "boolean")


def _linked(percent: int, size: int):
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for a, b in batches:
            out, sets = [], {}
            for x, y in zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist()):
                if y not in sets:  # the end of a band stands beside many members
                    sets = {y: shingles(y, hashes, size)}
                p, q = shingles(x, hashes, size), sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.array(out, pa.bool_())

    linked.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(linked, "boolean")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that are links, by the full sets of their texts."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_linked(percent, size)(F.col("text_a"), F.col("text_b"))).select("a", "b")


def _compare_blocks(percent: int, size: int = SHINGLE):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (key, band, i, j, rep, root, n, side, registers, text): links that join the roots of each block."""
        hashes = WordHashes()
        rest: list[dict] = []
        for batch in batches:
            rows = rest + batch.to_pylist()
            last = (rows[-1]["key"], rows[-1]["i"], rows[-1]["j"])
            done = [r for r in rows if (r["key"], r["i"], r["j"]) != last]
            rest = rows[len(done) :]
            yield links_of(done, hashes)
        yield links_of(rest, hashes)

    def links_of(rows: list[dict], hashes: WordHashes) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        start = 0
        for k in range(1, len(rows) + 1):
            if k < len(rows) and all(rows[k][c] == rows[start][c] for c in ("key", "i", "j")):
                continue
            found += compare_group(rows[start:k], hashes)
            start = k
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare_group(rows: list[dict], hashes: WordHashes) -> list[tuple[int, int]]:
        same = rows[0]["i"] == rows[0]["j"]
        matrix = np.frombuffer(b"".join(r["registers"] for r in rows), dtype="<u2").reshape(-1, BUCKETS)
        rep, root, n, side, band = (np.array([r[c] for r in rows]) for c in ("rep", "root", "n", "side", "band"))
        candidates: dict[int, np.ndarray] = {}
        for k in range(len(rows)):
            other = (rep > rep[k]) if same else (side > side[k])
            other = np.flatnonzero(other & (root != root[k]))
            if len(other):
                equal = matrix[other] == matrix[k]
                good = may_link(equal.sum(axis=1), n[other], n[k], percent)
                # A pair that shares several bands is verified in the first of them.
                first = equal[good].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                other = other[good][first == band[k]]
                if len(other):
                    candidates[k] = other
        return verified(rows, candidates, rep, root, hashes) if candidates else []

    def verified(rows: list[dict], candidates: dict[int, np.ndarray], rep, root, hashes: WordHashes) -> list[tuple[int, int]]:
        """Of the candidates of each row, links by the full sets that join different roots."""
        needed = np.unique(np.concatenate([*candidates.values(), list(candidates)]))
        sets = [shingles((rows[k]["text"] or "").encode(), hashes, size) for k in needed]
        lengths = np.zeros(len(rows), np.int64)
        lengths[needed] = [len(x) for x in sets]
        known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        of = dict(zip(needed.tolist(), np.split(numbers, np.cumsum(lengths[needed])[:-1])))
        marked, label, out = np.zeros(len(known), bool), root.copy(), []
        for k, other in candidates.items():
            other = other[label[other] != label[k]]
            marked[of[k]] = True
            for at in range(0, len(other), 100):
                some = other[at : at + 100]
                starts = np.cumsum(lengths[some]) - lengths[some]
                common = np.add.reduceat(marked[np.concatenate([of[g] for g in some.tolist()])], starts, dtype=np.int64)
                for g in some[100 * common >= percent * (lengths[k] + lengths[some] - common)]:
                    if label[g] != label[k]:
                        label[label == label[g]] = label[k]
                        out.append((int(max(rep[k], rep[g])), int(min(rep[k], rep[g]))))
            marked[of[k]] = False
        return out

    return compare


def _one_node_per_set(
    linkable: DataFrame, classes: DataFrame, texts: DataFrame, size: int
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Adds ``rep``, the node that stands for a set, to ``classes``; the texts by node; and links between
    the sets of one id, if there are any.

    A set's node is its least id. Where that id has texts with different sets, each of its
    sets gets a number above all ids instead, and is linked with the id.
    """
    print_of = F.xxhash64("set_id")
    repeated = linkable.groupBy("doc_id").agg(F.min(print_of).alias("p"), F.max(print_of).alias("q"))
    repeated = stored(repeated.where("p <> q").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return classes.withColumn("rep", F.col("least")), texts, None
    largest = linkable.agg(F.max("doc_id")).first()[0]
    shared = classes.join(repeated, F.col("least") == F.col("doc_id")).select("set_id", "least")
    numbers = number_rows(shared, [F.col("least"), F.col("set_id")], "number").select(
        F.col("set_id").alias("own"), (F.col("number") + F.lit(largest)).alias("node")
    )
    classes = classes.join(numbers, F.col("set_id") == F.col("own"), "left")
    classes = stored(classes.select("set_id", "least", F.coalesce("node", "least").alias("rep")), "nodes")
    of_repeated = linkable.join(repeated, "doc_id").select("doc_id", "set_id").distinct()
    links = of_repeated.join(classes, "set_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sketched = texts.join(repeated, "doc_id").withColumn("set_id", sketch_column(F.col("text"), size)["set_id"])
    own = sketched.join(classes.where("rep <> least"), "set_id").where(F.col("doc_id") == F.col("least"))
    texts = texts.unionAll(own.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    return classes, texts, links.where("a <> b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """A line per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links, the own id included; ``kept`` marks
    the row whose id it is. Rows without words are linked with nothing. Rows that repeat an id
    count as one document, so the sets of all its texts are in one component; rows without an id are
    kept, have no component and link nothing.
    """
    rows = id_and_text(docs, id_col, text_col)
    sketched = rows.select("doc_id", sketch_column(F.col("text"), size).alias("s")).select("doc_id", "s.*")
    sketches = stored(sketched, "sketches")
    linkable = sketches.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = stored(linkable.groupBy("set_id").agg(F.min("doc_id").alias("least")), "classes")
    texts = rows.where(F.col("doc_id").isNotNull())
    classes, texts, same_id = _one_node_per_set(linkable, classes, texts, size)
    reps = stored(
        linkable.join(classes, (F.col("doc_id") == F.col("least")) & (linkable["set_id"] == classes["set_id"]), "inner")
        .select("rep", F.col("n_shingles").alias("n"), "registers")
        .dropDuplicates(["rep"]),
        "reps",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = reps.select("rep", "registers", band.alias("band")).select(
        "rep",
        "band",
        F.xxhash64("band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"),
    )
    groups = stored(
        bands.groupBy("key")
        .agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1),
        "groups",
    )
    members = stored(bands.join(groups, "key"), "members")
    center = F.when(F.pmod("key", F.lit(2)) == 0, F.col("low")).otherwise(F.col("high"))
    ends = members.select("rep", center.alias("end")).where(F.col("rep") != F.col("end"))
    ends = ends.groupBy("rep").agg(F.min("end").alias("x"), F.max("end").alias("y"))
    pairs = ends.select("rep", F.explode(F.array_distinct(F.array("x", "y"))).alias("end"))
    pairs = pairs.select(F.greatest("rep", "end").alias("a"), F.least("rep", "end").alias("b")).distinct()
    sketch_a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    sketch_b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    near = pairs.join(sketch_a, "a").join(sketch_b, "b")
    near = near.where(_candidate(percent)(F.col("r_a"), F.col("r_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    links = _verified(stored(near, "near"), texts, percent, size).distinct()
    links = stored(links if same_id is None else links.unionAll(same_id), "links")
    roots = components(links)

    # Second pass: bands with members in different components.
    labelled = members.join(roots, members["rep"] == roots["node"], "left").select(
        "key", "band", "rep", "members", F.coalesce("root", "rep").alias("root")
    )
    labelled = stored(labelled, "labelled")
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
        .where(F.col("r0") != F.col("r1"))
        .select("key")
    )
    open_members = stored(labelled.join(stored(mixed, "mixed"), "key"), "open")
    # A node's texts all have its set.
    open_texts = texts.join(open_members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    open_texts = stored(open_texts.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "texts")
    lengths = open_members.join(open_texts.select("rep", F.octet_length("text").alias("bytes")), "rep")
    chunks = F.greatest(F.ceil(F.max("members") / F.lit(BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES)))
    chunks = stored(lengths.groupBy("key").agg(chunks.cast("int").alias("chunks")), "chunks")
    blocks = (
        open_members.join(chunks, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
        .join(reps, "rep")
        .join(open_texts, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "key",
            "band",
            F.least("chunk", "other").alias("i"),
            F.greatest("chunk", "other").alias("j"),
            "rep",
            "root",
            "n",
            F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"),
            "registers",
            "text",
        )
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    more_links = blocks.mapInArrow(_compare_blocks(percent, size), "a long, b long")
    roots = components(links.unionAll(more_links))

    labels = stored(
        classes.join(roots, classes["rep"] == roots["node"], "left").select(
            "set_id", F.coalesce("root", "rep").alias("root")
        ),
        "labels",
    )
    # Rows without words have no set; a key of their own keeps them apart from each other.
    own = F.coalesce("set_id", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string").cast("binary"))
    labels = labels.withColumnRenamed("set_id", "known")
    out = sketches.join(labels, own == F.col("known"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
