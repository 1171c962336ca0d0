"""Toxicity by subword bags: averaged embeddings into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with marks for its ends) and itself, hashed into
a table of embeddings; a text is the average of its words, a word counting by the square root of its occurrences, so that a line of one repeated word decides nothing. Embeddings and softmax are trained
together on a bounded sample of labelled documents, so that a misspelling that was never seen
still shares most of its n-grams with words that were.

The average and the softmax are linear, so a trained model is one weight per n-gram. Scoring looks
up the weight of a word, or adds it up from its n-grams once, and averages over the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table

# Labelled documents that are not toxic and that are, of which at most so many are trained on.
MAX_SAMPLE = (4000, 2000)
# Code points of all texts trained on, at most; each class has its part by its number of documents.
MAX_CHARS = 32_000_000
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 8
# A small sample is gone through more often, for so many steps in all.
MIN_STEPS = 500
BATCH = 64
RATE = 0.4
# The average is multiplied by this: a few words in a hundred decide.
SCALE = 20.0
# N-grams of less than one training text in so many are not learnt from: they would be learnt by heart.
RARE = 400
# Every text has so many more words that say nothing, so that one word of a short text decides little.
NEUTRAL = 8.0
# Words whose weights a task remembers.
MAX_WORDS = 400_000
FOLDS = 5

WORD = re.compile(r"\w+")


def grams(word: str) -> list[int]:
    """Buckets of the n-grams of a word."""
    data = f"<{word}>"
    found = [data]
    for size in (3, 4, 5):
        found += [data[i : i + size] for i in range(len(data) - size + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in found]


class Bags:
    """The words of some texts as bags of n-grams, and the texts as shares of words.

    Kept by word, so that its size follows the distinct words and not the n-grams of the texts.
    """

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.words, self.shares = [], []
        for text in texts:
            counts = Counter(WORD.findall(text.lower()))
            weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
            ids = [number.setdefault(w, len(number)) for w in counts]
            self.words.append(np.array(ids, np.int32))
            self.shares.append((weights / (NEUTRAL + weights.sum())).astype(np.float32))
        bags = [np.array(grams(w), np.int32) for w in number]
        self.sizes = np.array([len(b) for b in bags], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(bags) if bags else np.empty(0, np.int32)

    def frequent(self) -> np.ndarray:
        """Which buckets are in enough texts to learn from (a text counts for each of its words)."""
        of_word = np.bincount(np.concatenate(self.words), minlength=len(self.sizes))
        of_gram = np.bincount(self.flat, np.repeat(of_word, self.sizes), BUCKETS)
        return of_gram >= max(3, len(self.words) // RARE)

    def batch(self, part: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the texts of a batch: place in the batch, bucket and share of every n-gram."""
        words = np.concatenate([self.words[i] for i in part])
        shares = np.concatenate([self.shares[i] for i in part])
        texts = np.repeat(np.arange(len(part)), [len(self.words[i]) for i in part])
        sizes = self.sizes[words]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.flat[np.repeat(self.starts[words], sizes) + inside]
        known = frequent[ids]
        return np.repeat(texts, sizes)[known], ids[known], np.repeat(shares / sizes, sizes)[known].astype(np.float32)


class Model:
    """The trained weights: one per bucket, a bias, and the log odds of a text without words."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def word(self, word: str) -> float:
        return float(self.weights[grams(word)].mean())

    def score(self, text: str, known: dict[str, float]) -> float:
        total = weight = 0.0
        for w, count in Counter(WORD.findall(text.lower())).items():
            value = known.get(w)
            if value is None:
                if len(known) >= MAX_WORDS:
                    known.clear()
                value = known[w] = self.word(w)
            share = count**0.5
            total += share * value
            weight += share
        logit = self.bias + SCALE * total / (NEUTRAL + weight) if weight else self.prior
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    """Embeddings and softmax by minibatch Adagrad. Without both classes, the prior alone."""
    y = np.array(toxic, np.int64)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior, prior)
    bags = Bags(texts)
    frequent = bags.frequent()
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    filled = np.array([i for i, w in enumerate(bags.words) if len(w)], np.int64)
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // max(len(filled), 1)))
    for epoch in range(epochs if len(filled) else 0):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(filled)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            of, ids, shares = bags.batch(part, frequent)
            if not len(ids):
                continue
            # Texts by distinct n-grams, so that a step touches each embedding once.
            cells, where = np.unique(ids.astype(np.int64) * len(part) + of, return_inverse=True)
            shares = np.bincount(where, shares, len(cells)).astype(np.float32)
            of, ids = cells % len(part), cells // len(part)
            places, where = np.unique(ids, return_inverse=True)
            vectors = table_[places]
            mean = np.stack(
                [np.bincount(of, vectors[where, d] * shares, len(part)) for d in range(DIMENSIONS)], 1
            ).astype(np.float32) * SCALE
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            to_out, to_bias, to_mean = mean.T @ p, p.sum(axis=0), SCALE * (p @ out.T)
            step = np.stack(
                [np.bincount(where, to_mean[of, d] * shares, len(places)) for d in range(DIMENSIONS)], 1
            ).astype(np.float32)
            squares[0][places] += (step**2).mean(axis=1)
            table_[places] -= rate * step / np.sqrt(squares[0][places])[:, None]
            squares[1] += to_out**2
            out -= rate * 0.2 * to_out / np.sqrt(squares[1])
            squares[2] += to_bias**2
            bias -= rate * 0.2 * to_bias / np.sqrt(squares[2])
    difference = out[:, 1] - out[:, 0]
    weights = np.where(frequent, table_ @ difference, 0).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]), min(prior, 0.0))


def held_out(id_column: Column) -> Column:
    """Whether a document belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _within(sizes: list[tuple[int, int, int]], max_sample: tuple[int, int], max_chars: int) -> list[int]:
    """Keys of ``(key, mark, length)`` that fit into the part of their class, in the order given. A text that is too
    long for what is left is passed over whole; the next ones may fit."""
    left = [max_chars * n // max(sum(max_sample), 1) for n in max_sample]
    chosen = []
    for key, mark, length in sizes:
        if length <= left[mark]:
            left[mark] -= length
            chosen.append(key)
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_sample: tuple[int, int] = MAX_SAMPLE, max_chars: int = MAX_CHARS,
) -> Model:
    """Trains on the labelled documents outside the held-out fold, at most ``max_sample`` of each
    class (not toxic, toxic), chosen by a hash of the id. Rows without id, text or label are not learnt from; a
    document with several labels counts as toxic if one of them says so; of rows that repeat an id the one with
    the least text is learnt from. Whole texts of at most ``max_chars`` code points in all come to the driver.
    """
    marks = labels.select(named(id_col).cast("long").alias("key"), named(label_col).cast("int").alias("mark")).dropna()
    marks = marks.where(~held_out(F.col("key"))).groupBy("key").agg(F.max("mark").alias("mark"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = [marks.where(F.col("mark") == m).orderBy(*order).limit(max_sample[m]) for m in (0, 1)]
    sample = docs.select(named(id_col).cast("long").alias("key"), named(text_col).alias("text")).dropna()
    # The ids are as many as max_sample at most, whatever the tables.
    sample = sample.join(F.broadcast(chosen[0].unionAll(chosen[1])), "key").groupBy("key")
    sample = stored(sample.agg(F.min("text").alias("text"), F.max("mark").alias("mark")), "sample")
    sizes = sample.select("key", "mark", F.length("text"), F.xxhash64("key")).collect()
    sizes.sort(key=lambda r: (r[3], r[0]))
    keys = _within([tuple(r[:3]) for r in sizes], max_sample, max_chars)
    rows = sample.where(F.col("key").isin(keys)).collect()
    rows.sort(key=lambda r: r["key"])
    return train([r["text"] for r in rows], [r["mark"] for r in rows])


def score_column(text: Column, model: Model) -> Column:
    """Probability that a text is toxic, over the whole text; null and empty texts get the share of toxic texts in training."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in texts:
            yield pa.array(
                [shared.value.score(t.as_py() or "", known) for t in batch], pa.float64()
            )

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(text)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    scored = docs.select("doc_id", score_column(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
