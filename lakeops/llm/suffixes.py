"""Removal of passages that an earlier document holds, by sorted ranges of suffixes.

A byte goes if it lies in a string of 50 bytes that also starts in a document with a smaller id.

Suffixes are sampled by content: of the 31 20-byte strings in a 50-byte window the one with the
least hash is the window's anchor, so equal windows have equal anchors, and the windows of one
anchor are carried as one short run of text.

1. Exact copies of a text are settled by their digest; the first of each goes on. Texts are written
   once, in blocks by id, so that later steps read them in place.
2. Blocks send the distinct hashes of their anchors, four bytes each, to buckets of hashes, and get
   a bit back for each that another document has. This only saves work: unshared text ends here.
3. The runs of shared anchors are range-partitioned by their leading bytes (and the id, so that a
   very frequent passage is spread over many ranges; Spark samples the splitters). Every range
   sorts its suffixes by multikey quicksort; of equal ones, those of later documents are marked.
4. A lead that lies in several ranges is compared across them: each range sends its windows that are
   still unmarked to buckets of hashes, a line per task and bucket, which sort them once more.
5. The marks go back to the blocks, and the covered bytes are cut out.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table
from lakeops.session import scratch_path

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # grams in a window
# Bytes of text of a block, and anchors of a bucket, at most about.
BLOCK_BYTES = 8 << 20
BUCKET_ANCHORS = 1 << 20
# Windows of a text that are looked at together.
SEGMENT = 1 << 19
# Windows that a task sends on in one piece, and windows of a bucket, at about.
PACK = 1 << 18
BUCKET_WINDOWS = 1 << 16
_PLACE = np.uint64((1 << 20) - 1)
_BYTES = np.random.default_rng(97).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of ``GRAM`` bytes."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 2**64))
    h1 = _BYTES[data]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    n = len(data) - GRAM + 1
    h = h16[:n] * power(4) + h4[16 : 16 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash and place of the anchor, first and last window."""
    data = np.frombuffer(text, np.uint8)
    parts = []
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        h = gram_hashes(data[at : at + SEGMENT + LENGTH - 1])
        # Least hash first, then the leftmost place.
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        for size in (1, 2, 4, 8):
            m = np.minimum(m[:-size], m[size:])
        m = np.minimum(m[: len(m) - 15], m[15:])  # windows of 16, 15 apart: 31
        place = (m & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        parts.append((h[place[first]], place[first] + at, first + at, last + at))
    if not parts:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def later_copies(notes: pa.Table) -> dict[int, set[bytes]]:
    """Digests of the texts of an id that an earlier document has as a whole."""
    found: dict[int, set[bytes]] = {}
    for note in notes.select(["doc_id", "digest"]).to_pylist():
        if note["digest"] is not None:
            found.setdefault(note["doc_id"], set()).add(note["digest"])
    return found


def is_later(row: dict, later: dict[int, set[bytes]]) -> bool:
    digests = later.get(row["doc_id"])
    return digests is not None and hashlib.sha256(row["text"].encode()).digest() in digests


class Block:
    """The anchors of a block of documents, in the order of their ids."""

    def __init__(self, rows: pa.Table, notes: pa.Table):
        later = later_copies(notes)
        found = sorted(
            (r["doc_id"], r["nth"], r["text"].encode())
            for r in rows.to_pylist()
            if r["doc_id"] is not None and not is_later(r, later)
        )
        self.ids, self.nth, self.texts = ([r[k] for r in found] for k in range(3))
        found = [anchors(t) for t in self.texts]
        none = [np.empty(0, np.int64)]
        self.hash = np.concatenate([x[0] for x in found] + [np.empty(0, np.uint64)])
        self.place, self.first, self.last = (np.concatenate([x[k] for x in found] + none) for k in (1, 2, 3))
        self.doc = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        self.distinct, self.where = np.unique(self.hash, return_inverse=True)

    def several(self) -> np.ndarray:
        """Which distinct hashes lie in two documents of the block."""
        ids = np.array(self.ids, np.int64)[self.doc] if len(self.doc) else np.empty(0, np.int64)
        low = np.full(len(self.distinct), np.iinfo(np.int64).max)
        high = np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.where, ids)
        np.maximum.at(high, self.where, ids)
        return low != high


def _send(buckets: int):
    bits = np.uint64(64 - buckets.bit_length() + 1)

    def send(rows: pa.Table, notes: pa.Table) -> pa.Table:
        number = (rows if rows.num_rows else notes)["block"][0].as_py()
        block = Block(rows, notes)
        several = block.several()
        edges = np.searchsorted(block.distinct, np.arange(buckets, dtype=np.uint64) << bits) if buckets > 1 else np.array([0])
        edges = np.append(edges, len(block.distinct))
        rest = (block.distinct >> (bits - np.uint64(32))).astype(np.uint32)
        out = [
            {"bucket": k, "block": number, "hashes": rest[a:b].tobytes(), "several": np.packbits(several[a:b]).tobytes()}
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
            if b > a
        ]
        kind = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])
        return pa.Table.from_pylist(out, kind)

    return send


def _answer(rows: pa.Table) -> pa.Table:
    """For each block, which of its hashes in this bucket lie in more than one document."""
    parts = [np.frombuffer(x, np.uint32) for x in rows["hashes"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows["several"].to_pylist(), parts)]
    _, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    counts = counts + np.bincount(where, np.concatenate(several), len(counts)).astype(np.int64)
    shared = counts[where] > 1
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(shared[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]
    return pa.table(
        {"bucket": rows["bucket"], "block": rows["block"], "size": pa.array([len(p) for p in parts], pa.int32()), "shared": pa.array(bits, pa.binary())}
    )


RUN = "lead binary, doc_id long, at long, mask long, windows int, run binary"
RUN_SCHEMA = pa.schema(
    [("lead", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int64()), ("mask", pa.int64()), ("windows", pa.int32()), ("run", pa.binary())]
)


def _place(nth: int, start: int) -> int:
    """The row of a document that repeats its id, and a place in its text, in one number."""
    return (nth << 40) | start


def _runs(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Runs of windows with shared anchors. Of equal runs in a block the first document's goes on,
    later documents' are marked at once (all windows, ``run`` null)."""
    block = Block(rows, answers)
    told = sorted((r["bucket"], r["size"], r["shared"]) for r in answers.to_pylist() if r["shared"] is not None)
    if not told:
        return RUN_SCHEMA.empty_table()
    shared = np.concatenate(
        [np.unpackbits(np.frombuffer(bits, np.uint8), count=size) for _, size, bits in told]
    ).astype(bool)
    seen: dict[bytes, int] = {}
    out = {name: [] for name in RUN_SCHEMA.names}
    chosen = np.flatnonzero(shared[block.where])
    for doc, place, first, last in zip(*(x[chosen].tolist() for x in (block.doc, block.place, block.first, block.last))):
        text, doc_id = block.texts[doc], block.ids[doc]
        run, windows = text[first : last + LENGTH], last - first + 1
        lead = text[place : place + GRAM]
        earlier = seen.setdefault(run + bytes((place - first,)), doc_id)
        out["doc_id"].append(doc_id)
        out["at"].append(_place(block.nth[doc], first))
        out["windows"].append(windows)
        if earlier != doc_id:
            out["lead"].append(hashlib.blake2b(run, digest_size=8).digest() + doc_id.to_bytes(8, "big", signed=True))
            out["mask"].append((1 << windows) - 1)
            out["run"].append(None)
        else:
            out["lead"].append(lead)
            out["mask"].append(0)
            out["run"].append(run)
    return pa.Table.from_pydict(out, RUN_SCHEMA)


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of 64-bit words: the order, and a number for each group of equal rows in it.

    Multikey quicksort with a word as the character: rows are ordered by their first word; groups
    of equal ones go on to the next word, and only groups that differ there are ordered by it.
    """
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    group = np.cumsum(np.concatenate(([0], (first[1:] != first[:-1]).astype(np.int64))))
    for k in range(1, keys.shape[1]):
        word = keys[order, k]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        differs = word != word[starts][group]
        mixed = np.zeros(len(starts), bool)
        mixed[group[differs]] = True
        rows = np.flatnonzero(mixed[group])
        if len(rows):
            inner = np.lexsort((word[rows], group[rows]))
            order[rows] = order[rows][inner]
            word[rows] = word[rows][inner]
        cut = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(np.concatenate(([0], cut.astype(np.int64))))
    return order, group


def window_keys(runs: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the runs as seven big-endian words, with its run and its place in it."""
    lengths = windows + LENGTH - 1
    data = np.frombuffer(b"".join(runs) + bytes(8), np.uint8)
    starts = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(runs)), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[run] + place
    # The eight bytes from every place on, as one word.
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[k : len(data) - 7 + k]
    whole, rest = divmod(LENGTH, 8)
    keys = np.empty((len(run), whole + 1), np.uint64)
    for k in range(whole):
        keys[:, k] = words[at + 8 * k]
    keys[:, whole] = words[at + 8 * whole] >> np.uint64(64 - 8 * rest)
    return keys, run, place


def of_later_ids(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of the keys that a smaller id has too."""
    order, group = multikey_order(keys)
    ids = ids[order]
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return order[ids > least[group]]


def mark_repeats(runs: list[bytes], windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each run a mask of its windows that a smaller id has too."""
    keys, run, place = window_keys(runs, windows)
    late = of_later_ids(keys, ids[run])
    masks = np.zeros(len(runs), np.int64)
    np.bitwise_or.at(masks, run[late], np.int64(1) << place[late])
    return masks


def _sort_range(batches):
    """One range of sorted leads: marks of all its runs; the runs of its first and last lead go on too."""
    rows = pa.Table.from_batches(list(batches), RUN_SCHEMA).combine_chunks()
    if not rows.num_rows:
        return
    masks, windows = rows["mask"].to_numpy().copy(), rows["windows"].to_numpy().astype(np.int64)
    is_open = rows["run"].is_valid().to_numpy()
    edge = np.zeros(len(masks), bool)
    if is_open.any():
        opened = rows.filter(pa.array(is_open))
        masks[is_open] = mark_repeats(opened["run"].to_pylist(), windows[is_open], opened["doc_id"].to_numpy())
        ends = pc.min_max(opened["lead"])
        outer = pc.or_(pc.equal(rows["lead"], ends["min"]), pc.equal(rows["lead"], ends["max"])).to_numpy()
        # What is marked has an earlier equal window in this range, which goes on for both.
        edge = is_open & outer & (masks != (np.int64(1) << windows) - 1)
    run = pc.if_else(pa.array(edge), rows["run"].combine_chunks(), pa.scalar(None, pa.binary()))
    places = {name: i for i, name in enumerate(RUN_SCHEMA.names)}
    rows = rows.set_column(places["mask"], "mask", pa.array(masks, pa.int64())).set_column(places["run"], "run", run)
    yield from rows.filter(pa.array((masks != 0) | edge)).cast(RUN_SCHEMA).to_batches(max_chunksize=50_000)


PACKED = "bucket int, windows binary, origins binary"


def _pack(buckets: int):
    """Windows that are not marked, packed by buckets of their hashes: their bytes, and where each is
    from (doc_id, at, place). A line holds up to ``PACK`` windows of a bucket from one task."""
    kind = pa.schema([("bucket", pa.int32()), ("windows", pa.binary()), ("origins", pa.binary())])

    def lines(held: dict[int, tuple[list, list]]) -> pa.RecordBatch:
        columns = [
            pa.array(list(held), pa.int32()),
            pa.array([b"".join(windows) for windows, _ in held.values()], pa.binary()),
            pa.array([np.array(origins, np.int64).tobytes() for _, origins in held.values()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=kind)

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                for k in range(r["windows"]):
                    if r["mask"] >> k & 1:
                        continue
                    window = r["run"][k : k + LENGTH]
                    windows, origins = held.setdefault(xxhash.xxh3_64_intdigest(window) % buckets, ([], []))
                    windows.append(window)
                    origins.append((r["doc_id"], r["at"], k))
                    size += 1
                if size >= PACK:
                    yield lines(held)
                    held, size = {}, 0
        if held:
            yield lines(held)

    return pack


def _across(rows: pa.Table) -> pa.Table:
    """Marks of the windows of a bucket that a smaller id has too, a line per run."""
    windows = rows["windows"].to_pylist()
    origins = np.frombuffer(b"".join(rows["origins"].to_pylist()), np.int64).reshape(-1, 3)
    keys, _, _ = window_keys([w[i : i + LENGTH] for w in windows for i in range(0, len(w), LENGTH)], np.ones(len(origins), np.int64))
    late = origins[of_later_ids(keys, origins[:, 0])]
    runs, of = np.unique(late[:, :2], axis=0, return_inverse=True)
    masks = np.zeros(len(runs), np.int64)
    np.bitwise_or.at(masks, of.ravel(), np.int64(1) << late[:, 2])
    return pa.table({"doc_id": runs[:, 0], "at": runs[:, 1], "mask": masks})


def covered(size: int, starts, masks) -> np.ndarray:
    """Starts and ends of the maximal runs of bytes in marked windows, in turn."""
    edges = np.zeros(size + 1, np.int64)
    for start, mask in zip(starts, masks):
        while mask:
            k = (mask & -mask).bit_length() - 1
            run = ((mask >> k) ^ ((mask >> k) + 1)).bit_length() - 1  # consecutive windows
            edges[start + k] += 1
            edges[start + k + run - 1 + LENGTH] -= 1
            mask &= ~(((1 << run) - 1) << k)
    hit = np.cumsum(edges[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))


def _finish(with_text: bool):
    """Cuts the marked bytes out of a block's texts."""

    def finish(rows: pa.Table, marks: pa.Table) -> pa.Table:
        later, found = later_copies(marks), {}
        for m in marks.to_pylist():
            if m["mask"] is not None:
                found.setdefault((m["doc_id"], m["at"] >> 40), []).append((m["at"] & ((1 << 40) - 1), m["mask"]))
        out = []
        for r in rows.to_pylist():
            text, spans = r["text"].encode(), []
            if is_later(r, later):
                spans = [0, len(text)] if len(text) >= LENGTH else []
            elif (r["doc_id"], r["nth"]) in found:
                spans = covered(len(text), *zip(*found[r["doc_id"], r["nth"]])).tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(text)]))
            out.append(
                {"doc_id": r["doc_id"], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans) // 2,
                 "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None}
            )
        return pa.Table.from_pylist(out, RESULT_SCHEMA)

    return finish


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """A line per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    remaining bytes, null unless ``with_text``).

    A null text counts as empty; a row without an id keeps all its bytes and is nobody's source.
    Rows that repeat an id are one document: they never cut each other.
    """
    spark = docs.sparkSession
    rows = docs.select(
        named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    block_of = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    digests = rows.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    )
    digests = stored(digests, "digests")
    sources = digests.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    sources = stored(sources.where(F.col("source") < F.col("last")).select("digest", "source"), "sources")
    later = stored(
        digests.join(sources, "digest").where(F.col("doc_id") > F.col("source")).select(
            block_of("doc_id").alias("block"), "doc_id", "digest"
        ),
        "later",
    )
    name = f"suffix_texts_{uuid.uuid4().hex}"
    (
        rows.withColumn("block", block_of(F.coalesce("doc_id", F.xxhash64("text"))))
        .repartition(blocks, "block")
        .withColumn("nth", F.expr("cast(monotonically_increasing_id() & 4194303 as int)"))
        .write.option("path", scratch_path(spark, "suffix-texts"))
        .bucketBy(blocks, "block")
        .saveAsTable(name)
    )
    texts = spark.table(name)
    buckets = 1
    while buckets * BUCKET_ANCHORS < total // 14:
        buckets *= 2
    sent = (
        texts.groupBy("block")
        .cogroup(later.groupBy("block"))
        .applyInArrow(_send(buckets), "bucket int, block int, hashes binary, several binary")
    )
    answers = stored(
        sent.groupBy("bucket").applyInArrow(_answer, "bucket int, block int, size int, shared binary"), "answers"
    )
    notes = answers.unionByName(later, allowMissingColumns=True)
    runs = (
        texts.groupBy("block")
        .cogroup(notes.groupBy("block"))
        .applyInArrow(_runs, RUN)
        .repartitionByRange(blocks, "lead", "doc_id")
    )
    ranges = stored(runs.mapInArrow(_sort_range, RUN).withColumn("range", F.spark_partition_id()), "ranges")

    edges = ranges.where(F.col("run").isNotNull())
    spread = edges.groupBy("lead").agg(F.min("range").alias("r0"), F.max("range").alias("r1"))
    spread = stored(spread.where(F.col("r0") != F.col("r1")).select("lead"), "spread")
    # At most two leads a range.
    spread_runs = edges.join(F.broadcast(spread), "lead", "left_semi")
    n_windows = spread_runs.agg(F.sum("windows")).first()[0] or 0
    across = (
        spread_runs.mapInArrow(_pack(max(1, -(-n_windows // BUCKET_WINDOWS))), PACKED)
        .groupBy("bucket")
        .applyInArrow(_across, "doc_id long, at long, mask long")
    )
    marks = ranges.where(F.col("mask") != 0).select("doc_id", "at", "mask")
    marks = marks.unionAll(across)
    marks = marks.withColumn("block", block_of("doc_id")).unionByName(later, allowMissingColumns=True)
    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_finish(with_text), RESULT)


def op9_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
