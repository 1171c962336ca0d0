"""Benchmark decontamination with a broadcast hash set of test n-grams.

The words of the benchmark items become windows of 13 consecutive words (an item of fewer words is
one window). The windows are numbered word by word, hashed, and broadcast; every document is
scanned once with rolling hashes, and each hit is verified word for word. A benchmark beyond
``BLOCK_BYTES`` is cut into blocks of items, with a pass over the documents per block, so that a
broadcast stays below a known size whatever the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table

WINDOW = 13
# Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 4 << 20
# Hits are long runs of words; a document is contaminated from this share of its words on.
SHARE = 20

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# Bytes to word characters: A-Z in lower case, everything outside [0-9a-z\x80-\xff] a blank.
WORD_BYTES = bytes(
    b if b in _KEEP else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)
RESULT = "n_words long, n_hit long, hits array<int>, items array<string>"
MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes, A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def rolled(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every run of ``size`` numbers."""
    h = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    b = np.uint64(base)
    for k in range(size):
        h = h * b + ids[k : k + len(h)].astype(np.uint64)
    return h ^ (h >> np.uint64(29))


class WindowSet:
    """The windows of some items: by length, sorted hashes, words and items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        runs: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                runs.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item_id)
        self.lengths = {}
        for size, found in runs.items():
            words = np.array(list(found), dtype=np.int64).reshape(len(found), size)
            base = MULTIPLIER
            while True:
                hashes = np.concatenate([rolled(w, size, base) for w in words])
                if len(np.unique(hashes)) == len(hashes):
                    break
                base += 2
            order = np.argsort(hashes)
            owners = [sorted(found[tuple(words[i].tolist())]) for i in order]
            marks = np.zeros(1 << 16, dtype=bool)
            marks[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.lengths[size] = (base, hashes[order], words[order], owners, marks)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        n = len(words)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=n)
        edges = np.zeros(n + 1, dtype=np.int64)
        items: set = set()
        for size, (base, hashes, wanted, owners, marks) in self.lengths.items():
            if n < size:
                continue
            h = rolled(ids, size, base)
            at = np.flatnonzero(marks[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            same = hashes[place] == h[at]
            at, place = at[same], place[same]
            if not len(at):
                continue
            right = (ids[at[:, None] + np.arange(size)] == wanted[place]).all(axis=1)
            at, place = at[right], place[right]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            for p in np.unique(place):
                items.update(owners[p])
        return np.cumsum(edges[:-1]) > 0, items


def runs_of(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))


def _scanner(windows):
    """A column function of text and the hits so far; they add up from block to block."""

    def scan(texts: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for text, old_hits, old_items in zip(
            texts.cast(pa.binary()).to_pylist(), hits.to_pylist(), items.to_pylist()
        ):
            words = words_of(text or b"")
            hit, found = windows.value.scan(words)
            for start, end in zip(old_hits[::2], old_hits[1::2]):
                hit[start:end] = True
            found.update(old_items)
            out.append(
                {"n_words": len(words), "n_hit": int(hit.sum()), "hits": runs_of(hit).tolist(), "items": sorted(found)}
            )
        kind = pa.struct(
            [("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
        )
        return pa.array(out, kind)

    scan.__annotations__ = {"texts": pa.Array, "hits": pa.Array, "items": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, RESULT)


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    result_col: str = "contamination",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``result_col``: n_words, n_hit, hits (word positions, start and
    end in turn) and items (ids as strings, sorted). A column of that name is replaced.

    A null text has no words; items without an id or without words have no windows. Repeated
    documents are scanned alike, repeated items count once. Only ``text_col`` reaches Python.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        named(item_col).cast("string").alias("item"), named(item_text_col).cast("string").alias("words")
    ).dropna()
    total, count = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    nothing = F.struct(
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<int>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    out = docs.withColumn(result_col, nothing)
    block_of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for block in range(blocks):
        part = items.where(block_of == block) if blocks > 1 else items
        windows = spark.sparkContext.broadcast(
            WindowSet([(r["item"], r["words"].encode()) for r in part.collect()], window)
        )
        so_far = named(result_col)
        out = out.withColumn(
            result_col, _scanner(windows)(named(text_col).cast("string"), so_far["hits"], so_far["items"])
        )
        if blocks > 1:
            out = stored(out, "decontaminate")
    return out


def contaminated(result: Column, share: int = SHARE) -> Column:
    """Whether at least one word in ``share`` lies in a benchmark window."""
    return (result["n_hit"] > 0) & (share * result["n_hit"] >= result["n_words"])


def without_spans(spans_col: str, text_col: str):
    """Column: the text without the hit words and what stands between them."""

    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        out = []
        for text, runs in zip(texts.cast(pa.binary()).to_pylist(), hits.to_pylist()):
            if text is None or not runs:
                out.append(None if text is None else text.decode())
                continue
            places = [m.span() for m in word.finditer(text)]
            kept, last = [], 0
            for start, end in zip(runs[::2], runs[1::2]):
                kept.append(text[last : places[start][0]])
                last = places[end - 1][1]
            kept.append(text[last:])
            out.append(b"".join(kept).decode())
        return pa.array(out, pa.string())

    cut.__annotations__ = {"texts": pa.Array, "hits": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "string")(named(text_col).cast("string"), named(spans_col)["hits"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with every hit span cut from its text.

    ``remove`` is ``documents`` or ``spans``. The columns stay as they are.
    """
    result = "_contamination"
    while result in docs.columns:
        result += "_"
    scanned = scan_documents(docs, benchmark, text_col=text_col, result_col=result)
    if remove == "documents":
        return scanned.where(~contaminated(named(result))).drop(result)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    return scanned.withColumn(text_col, without_spans(result, text_col)).drop(result)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scanned = scan_documents(docs.select("doc_id", "text"), items, result_col="r")
    r = F.col("r")
    return scanned.select(
        "doc_id",
        r["n_words"].alias("n_words"),
        r["n_hit"].alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(r).alias("contaminated"),
    )
