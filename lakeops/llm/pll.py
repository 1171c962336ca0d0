"""Masked pseudo-likelihood: every token predicted from both sides, summed up for a document.

Words are counted over the whole corpus; the frequent ones have an id of their own, the others share
buckets by hash. The words are dealt to classes of about equal mass, and a token's probability is

    p(class | two tokens before, two after) * p(word or bucket | class, the same tokens) * p(word | bucket)

with the last factor from the corpus counts (by a join of each document's words with the table of all
counts, which stays in Spark; a bounded number of the most frequent ones all tasks have) and the others from a small window network in numpy: embeddings weighted
by place, summed, squashed, a softmax over the classes, and inside a class a Huffman tree of its words,
whose forks start from the corpus counts and learn to turn by the same context.

Training reads all documents. A hash of place and text deals every token to one round, as masks are. In
each round every task starts from the same weights, predicts its tokens of that round, and takes
gradient steps; the weights are averaged by token count, row by row, in a Spark aggregate. The driver gets the
averages only, whose size is fixed.
"""

from __future__ import annotations

import copy
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lakeops.llm.common import id_and_text, stored, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
TOKEN_OR_BREAK = re.compile(TOKEN.pattern + r"|\n")
WORDS = 8192
BUCKETS = 512
CLASSES = 64
DIMENSIONS = 16
SIDES = (-2, -1, 1, 2)
# Every token is predicted in one of the rounds of training.
ROUNDS = 2
BATCH = 512
# Tokens whose forks are in memory at a time.
PIECE = 1 << 11
RATE = 0.3
# Tokens that are scored together, and distinct words counted before they are sent on.
STEP = 1 << 15
MAX_COUNTED = 300_000
# Most frequent words whose own counts all tasks have; those of other words are joined.
RANKED = 100_000
# Runs of characters between white space that are remembered, and the longest of them.
MAX_RUNS = 200_000
MAX_RUN = 48
# Code points of texts, and runs, whose distinct runs are found at a time.
MAX_CHARS = 1 << 24
MAX_FOUND = 1 << 20
# Ids as they are stored: all are below WORDS + BUCKETS + 1.
PACKED = np.dtype("<u2")


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def words_of(run: str) -> list[str]:
    """The words of lower-cased text without white space."""
    return [run] if run.isalnum() else TOKEN.findall(run)


def runs_of(texts: pa.Array) -> Iterator[tuple[list[int], pa.DictionaryArray]]:
    """The runs between white space of lower-cased texts, some texts at a time: how many each text has, and
    all of them with their distinct ones as the dictionary."""
    lines: list[str] = []
    lengths: list[int] = []
    size = found = 0
    for text in texts:
        text = text.as_py() or ""
        runs = text.lower().split()
        lines += ["\n".join(runs)] if runs else []
        lengths.append(len(runs))
        size += len(text)
        found += len(runs)
        if size > MAX_CHARS or found > MAX_FOUND:
            yield lengths, distinct("\n".join([*lines, ""]))
            lines, lengths, size, found = [], [], 0, 0
    if lengths:
        yield lengths, distinct("\n".join([*lines, ""]))


def distinct(lines: str) -> pa.DictionaryArray:
    """Lines, each with a line break behind it, with their distinct ones as the dictionary."""
    data = np.frombuffer(lines.encode(), np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == ord("\n")) + 1])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data)]
    found = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, buffers).dictionary_encode()
    return pa.DictionaryArray.from_arrays(found.indices, pc.utf8_slice_codeunits(found.dictionary, 0, -1))


def cut(runs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of runs: the words (first those that are a run of their own), the run of each word, and
    where the words of each run begin and how many they are."""
    texts = runs.to_numpy(zero_copy_only=False).tolist()
    whole = np.fromiter(map(str.isalnum, texts), bool, len(texts))
    one, other = np.flatnonzero(whole), np.flatnonzero(~whole)
    # No run has a line break in it, so all can be cut as one text.
    found = pa.array(TOKEN_OR_BREAK.findall("".join([texts[i] + "\n" for i in other.tolist()])), runs.type)
    breaks = pc.equal(found, pa.scalar("\n", runs.type))
    lengths = np.diff(np.flatnonzero(breaks.to_numpy(zero_copy_only=False)), prepend=-1) - 1
    words = pa.concat_arrays([runs.take(pa.array(one)), found.filter(pc.invert(breaks))])
    starts, sizes = np.empty(len(texts), np.int64), np.ones(len(texts), np.int64)
    starts[one], starts[other] = np.arange(len(one)), len(one) + lengths.cumsum() - lengths
    sizes[other] = lengths
    return words, np.concatenate([one, other.repeat(lengths)]), starts, sizes


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    at = (starts - (lengths.cumsum() - lengths)).repeat(lengths)
    at += np.arange(len(at))
    return at


def word_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every word of all texts; tasks add up what they can hold first.

    No word has white space in it, so runs between white space are counted and each distinct one is
    cut into words once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def added() -> tuple[pa.Array, np.ndarray]:
            words = pa.concat_arrays([pa.array([], pa.large_string()), *(words for words, _ in held)]).dictionary_encode()
            # Sums below 2 ** 53 are exact.
            n = np.bincount(words.indices.to_numpy(), np.concatenate([np.zeros(0), *(n for _, n in held)]), len(words.dictionary))
            return words.dictionary, n.astype(np.int64)

        def sent(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": words.cast(pa.string()), "n": pa.array(n)})

        for batch in batches:
            for _, runs in runs_of(batch.column(0)):
                words, of, *_ = cut(runs.dictionary)
                held.append((words, np.bincount(runs.indices.to_numpy(), minlength=len(runs.dictionary)).take(of)))
                if sum(len(n) for _, n in held) > 2 * MAX_COUNTED:
                    held[:] = [added()]
                    if len(held[0][1]) > MAX_COUNTED:
                        yield sent(*held.pop())
        yield sent(*added())

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of words: 0 is no word, then the frequent ones, then the buckets of all others."""

    tables: tuple[pa.Array, np.ndarray, np.ndarray] | None = None

    def __init__(self, words: list[tuple[str, int]], others: list[int], pooled: list[tuple[str, int]] = ()):
        self.ids = {w: i for i, (w, _) in enumerate(words, 1)}
        self.first = len(words) + 1
        self.size = self.first + BUCKETS
        # Ids as they are stored, and what is known of the words themselves: as ``run`` has it.
        self.stored = [i.to_bytes(PACKED.itemsize, "little") for i in range(self.size)]
        self.known = {w: (self.stored[self.bucket(w)], (), math.log(n)) for w, n in pooled}
        self.known |= {w: (self.stored[i], (), 0.0) for w, i in self.ids.items()}
        mass = np.array([1.0] + [n for _, n in words] + [n + 1.0 for n in others])
        mass[0] = 0
        order = np.argsort(-mass[1:], kind="stable") + 1
        cumulative = np.cumsum(mass[order]) - mass[order] / 2
        self.of = np.zeros(self.size, np.int64)
        self.of[order] = np.minimum((cumulative / max(mass.sum(), 1) * CLASSES).astype(np.int64), CLASSES - 1)
        of_class = np.bincount(self.of[1:], mass[1:], CLASSES)
        self.inside = np.zeros(self.size)
        self.inside[1:] = np.log(mass[1:] / of_class[self.of[1:]])
        self.unigram = np.zeros(self.size)
        self.unigram[1:] = np.log(mass[1:] / mass.sum())
        # What a word of a bucket has less than its bucket, apart from the log of its own count.
        self.pooled = np.zeros(self.size)
        self.pooled[self.first :] = -np.log(mass[self.first :])
        self.plant(mass)

    def plant(self, mass: np.ndarray) -> None:
        """A Huffman tree for each class: forks on the way to a word (``paths``), turns taken there
        (``turns``), and the log odds of the forks by the counts."""
        forks, odds = [(0, 0)] * self.size, np.zeros(self.size)
        nodes = 0
        ways: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]
        for members in np.split(np.argsort(self.of[1:], kind="stable") + 1, np.cumsum(np.bincount(self.of[1:], minlength=CLASSES))[:-1]):
            # Negative numbers are words, others forks.
            heap = [(mass[i], -int(i)) for i in members]
            heapq.heapify(heap)
            while len(heap) > 1:
                (low, a), (high, b) = heapq.heappop(heap), heapq.heappop(heap)
                forks[nodes], odds[nodes] = (a, b), np.log(low / high)
                heapq.heappush(heap, (low + high, nodes))
                nodes += 1
            open_ = [(heap[0][1], [])] if heap else []
            while open_:
                node, way = open_.pop()
                if node < 0:
                    ways[-node] = way
                else:
                    open_ += [(child, [*way, (node, turn)]) for child, turn in zip(forks[node], (1, -1))]
        self.odds = odds.astype(np.float32)
        self.lengths = np.array([len(w) for w in ways])
        # Paths one after the other, with the log odds of the turns; a word's begins at its start.
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.paths = np.array([node for way in ways for node, _ in way], np.int64)
        self.turns = np.array([turn for way in ways for _, turn in way], np.float32)
        self.turned = self.turns * self.odds.take(self.paths)

    def forks(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The forks on the ways to words: which of ``ids``, which fork, which turn, its log odds by the
        counts."""
        lengths = self.lengths.take(ids)
        who = np.arange(len(ids)).repeat(lengths)
        at = spread(self.starts.take(ids), lengths)
        return who, self.paths.take(at), self.turns.take(at), self.turned.take(at)

    def without_words(self, tables: bool = False) -> Vocabulary:
        """For tasks that have ids only, or need words as ``tables`` only."""
        other = copy.copy(self)
        other.ids, other.known = {}, {}
        other.tables = self.as_tables() if tables else None
        return other

    def encode(self, text: str, known: dict[str, tuple]) -> np.ndarray:
        return np.frombuffer(b"".join(self.packed(text, known)[0]), PACKED).astype(np.int64)

    def packed(self, text: str, known: dict[str, tuple]) -> tuple[tuple, tuple, tuple]:
        """For each run between white space of a text: packed ids, pooled words whose counts are not known
        here, the logs of the counts of the others, summed up. Runs are looked at once and kept in ``known``."""
        run = self.run
        found = [known.get(r) or run(r, known) for r in text.lower().split()]
        return tuple(zip(*found)) if found else ((), (), ())

    def run(self, run: str, known: dict[str, tuple]) -> tuple[bytes, tuple, float]:
        """What ``packed`` has for one run."""
        words = self.known
        found = words.get(run)
        if found is None:
            packed, pooled, own = b"", (), 0.0
            for w in words_of(run):
                one = words.get(w)
                if one:
                    packed += one[0]
                    own += one[2]
                else:
                    packed += self.stored[self.bucket(w)]
                    pooled += (w,)
            found = packed, pooled, own
        if len(run) <= MAX_RUN:
            if len(known) >= MAX_RUNS:
                known.clear()
            known[run] = found
        return found

    def bucket(self, word: str) -> int:
        return self.first + zlib.crc32(word.encode()) % BUCKETS

    def as_tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is ``known`` of words as tables: the words, their ids, the logs of the counts of pooled ones."""
        packed, _, own = zip(*self.known.values()) if self.known else ((), (), ())
        return pa.array(list(self.known), pa.large_string()), np.frombuffer(b"".join(packed), PACKED), np.array(own, float)

    def found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of words: ids, the logs of the counts of pooled ones where they are known here, the numbers of the
        others (-1: known), and the others by number."""
        known, ids, own = self.tables or self.as_tables()
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        here, other = at >= 0, np.flatnonzero(at < 0)
        out, logs, numbers = np.empty(len(at), PACKED), np.zeros(len(at)), np.full(len(at), -1, np.int64)
        out[here], logs[here] = ids.take(at[here]), own.take(at[here])
        others = words.take(pa.array(other)).dictionary_encode()
        numbers[other] = others.indices.to_numpy()
        codes = np.fromiter(map(zlib.crc32, others.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.int64, len(others.dictionary))
        out[other] = (self.first + codes % BUCKETS).take(numbers[other])
        return out, logs, numbers, others.dictionary

    def encoded(self, lengths: list[int], runs: pa.DictionaryArray) -> pa.StructArray:
        """What ``encode_column`` has for texts, whose runs are as ``runs_of`` has them."""
        words, of, starts, sizes = cut(runs.dictionary)
        ids, logs, numbers, others = self.found(words)
        less = self.pooled.take(ids) + logs
        plain = self.unigram.take(ids) + less
        # Sums of distinct runs, then of texts.
        rows = np.arange(len(lengths)).repeat(np.array(lengths, np.int64))
        which = runs.indices.to_numpy()
        total = lambda x: np.bincount(rows, np.bincount(of, x, len(sizes)).take(which), len(lengths)).astype(float)
        less, plain = total(less), total(plain)
        times = sizes.take(which)
        at = spread(starts.take(which), times)
        n_tokens = np.bincount(rows, times, len(lengths)).astype(np.int64)
        ends = np.concatenate([[0], n_tokens.cumsum()])
        ids = pa.Array.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(ends * PACKED.itemsize), pa.py_buffer(ids.take(at))]
        )
        numbers = numbers.take(at)
        pooled = np.flatnonzero(numbers >= 0)
        keys = np.searchsorted(ends, pooled, side="right") - 1
        keys, times = np.unique(keys * max(len(others), 1) + numbers[pooled], return_counts=True)
        rows, numbers = np.divmod(keys, max(len(others), 1))
        ends = np.concatenate([[0], np.bincount(rows, minlength=len(lengths)).cumsum()])
        pairs = pa.StructArray.from_arrays([others.take(pa.array(numbers)).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
        return pa.StructArray.from_arrays(
            [ids.cast(pa.binary()), pa.array(n_tokens), pa.array(less), pa.array(plain), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
            ["ids", "n_tokens", "less", "unigram", "pooled"],
        )


def ids_of(column: pa.Array, vocabulary: Vocabulary, known: dict[str, tuple]) -> Iterator[np.ndarray]:
    """The ids of every text of a column, or of every row of ids that were packed before."""
    packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    for value in column:
        value = value.as_py()
        yield np.frombuffer(value or b"", PACKED).astype(np.int64) if packed else vocabulary.encode(value or "", known)


@cache
def _pairs(size: int) -> np.ndarray:
    """For each row below ``size``, where its numbers are among those of all rows, taken two at a time."""
    return np.arange(size * DIMENSIONS // 2).reshape(size, -1)


def _add(table: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Adds a vector to each row, which may repeat. Numbers are added two at a time, as complex ones."""
    at = _pairs(max(len(table), WORDS + BUCKETS + 1)).take(rows, axis=0)
    np.add.at(table.reshape(-1).view(np.complex64), at.reshape(-1), vectors.reshape(-1).view(np.complex64))
    return table


def _shares(counts: np.ndarray, n: int) -> np.ndarray:
    """Weights of rows by how often they are there: a rare row's few gradients count as much as a frequent
    one's many."""
    return (n / np.maximum(counts, 8)).astype(np.float32)[:, None]


def rounds_of(ids: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each token of a text is predicted."""
    places = np.arange(len(ids), dtype=np.uint64) + np.uint64(zlib.crc32(ids.tobytes()))
    return (((places * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(rounds)).astype(np.int64)


class Network:
    """Embeddings ``e``, weights of the places ``p``, softmax ``u`` and ``b``, forks inside classes ``v``."""

    tables: list[np.ndarray] | None = None

    def __init__(self, size: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.3, (size, DIMENSIONS)).astype(np.float32)
        self.e[0] = 0
        self.p = np.ones((len(SIDES), DIMENSIONS), np.float32) + rng.normal(0, 0.3, (len(SIDES), DIMENSIONS)).astype(np.float32)
        self.u = np.zeros((DIMENSIONS, CLASSES), np.float32)
        self.b = np.zeros(CLASSES, np.float32)
        # The corpus counts hold until something is learnt. No more forks than words.
        self.v = np.zeros((size, DIMENSIONS), np.float32)

    def copy(self) -> Network:
        other = Network.__new__(Network)
        other.e, other.p, other.u, other.b, other.v = (x.copy() for x in (self.e, self.p, self.u, self.b, self.v))
        return other

    def forward(self, padded: np.ndarray, at: np.ndarray):
        """Contexts, squashed sums and log-probabilities of the classes at places of padded ids."""
        around = padded[at[:, None] + np.array(SIDES)]
        h = np.tanh(np.einsum("nkd,kd->nd", self.e.take(around, axis=0), self.p))
        logits = h @ self.u + self.b
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return around, h, logits

    def inside(self, h: np.ndarray, ways: tuple[np.ndarray, ...]):
        """Forks on the ways to words of contexts ``h``, as ``Vocabulary.forks`` has them: which context, which
        fork and turn, both their vectors, log odds of the turn."""
        who, fork, turn, odds = ways
        hs, vs = h.take(who, axis=0), self.v.take(fork, axis=0)
        return who, fork, turn, hs, vs, turn * np.einsum("nd,nd->n", hs, vs) + odds

    def exponents(self, h: np.ndarray) -> np.ndarray:
        """The logits of contexts, a class a row; the largest of a context is 0."""
        logits = self.u.T @ h.T
        logits += self.b[:, None]
        logits -= logits.max(axis=0)
        return logits

    def learn(self, padded: np.ndarray, at: np.ndarray, vocabulary: Vocabulary, ways: tuple | None = None) -> None:
        """One gradient step, with the forks on the ways to its words if they are known."""
        n, rate = len(at), np.float32(RATE / len(at))
        ids = padded.take(at).astype(np.int64)
        around = padded.take(at[:, None] + np.array(SIDES)).astype(np.int64)
        vectors = self.e.take(around, axis=0)
        h = np.tanh(np.einsum("nkd,kd->nd", vectors, self.p))
        g = self.exponents(h)
        np.exp(g, out=g)
        g *= rate / g.sum(axis=0)
        g[vocabulary.of.take(ids), np.arange(n)] -= rate
        to_h = g.T @ self.u.T
        who, fork, turn, hs, vs, odds = self.inside(h, ways or vocabulary.forks(ids))
        if len(who):
            np.minimum(odds, 30, out=odds)
            np.exp(odds, out=odds)
            odds += 1
            wrong = (turn * -rate / odds)[:, None]
            vs *= wrong
            _add(to_h, who, vs)
            hs *= -wrong * _shares(np.bincount(fork).take(fork), n)
            _add(self.v, fork, hs)
        back = to_h * (1 - h * h)
        self.u -= 4 * (g @ h).T
        self.b -= 4 * g.sum(axis=1)
        to_e = np.concatenate([back] * len(SIDES), axis=1)
        to_e *= self.p.ravel()
        self.p -= np.einsum("nd,nkd->kd", back, vectors)
        counts = np.bincount(around.reshape(-1))
        places = counts.astype(bool).nonzero()[0]
        rank = np.empty(len(counts), np.int64)
        rank[places] = np.arange(len(places))
        step = _add(np.zeros((len(places), DIMENSIONS), np.float32), rank.take(around.reshape(-1)), to_e)
        step *= _shares(counts.take(places), n)
        np.minimum(step, 0.5, out=step)
        np.maximum(step, -0.5, out=step)
        self.e[places] = self.e.take(places, axis=0) - step
        self.e[0] = 0

    def score(self, ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Conditional log-probabilities of all tokens that are not 0; the first and last two are 0."""
        tables = self.placed()
        out = np.zeros(len(ids))
        for start in range(2, len(ids) - 2, PIECE):
            stop = min(start + PIECE, len(ids) - 2)
            own = ids[start:stop]
            # Neighbours of consecutive tokens are slices; each place has its weighted embeddings.
            h = tables[0].take(ids[start - 2 : stop - 2], axis=0)
            for weighted, side in zip(tables[1:], SIDES[1:]):
                h += weighted.take(ids[start + side : stop + side], axis=0)
            logits = self.exponents(np.tanh(h, out=h))
            chosen = logits[vocabulary.of.take(own), np.arange(stop - start)]
            norm = np.log(np.exp(logits, out=logits).sum(axis=0))
            who, *_, odds = self.inside(h, vocabulary.forks(own))
            # log(1 + exp(-odds)), whose exponent never grows large.
            costs = np.log(1 + np.exp(-np.abs(odds))) - np.minimum(odds, 0)
            out[start:stop] = np.where(own > 0, chosen - norm - np.bincount(who, costs, len(own)), 0)
        return out

    def placed(self) -> list[np.ndarray]:
        """Embeddings weighted by each place, made once for a trained network."""
        if self.tables is None:
            self.tables = [np.ascontiguousarray(self.e * p) for p in self.p]
        return self.tables

    def rows(self) -> np.ndarray:
        """All weights as rows of one width."""
        flat = np.concatenate([self.e.ravel(), self.p.ravel(), self.u.ravel(), self.b.ravel(), self.v.ravel()])
        return flat.reshape(-1, DIMENSIONS)

    def from_rows(self, rows: np.ndarray) -> Network:
        other, at = self.copy(), 0
        for x in (other.e, other.p, other.u, other.b, other.v):
            x[...] = rows.ravel()[at : at + x.size].reshape(x.shape)
            at += x.size
        return other


def _train_task(shared, round_: int, rounds: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = shared.value
        network, known, learnt = start.copy(), {}, 0
        none, never = np.zeros(2, np.int64), np.full(2, -1)
        held: list[np.ndarray] = []
        dealt: list[np.ndarray] = []
        size = 0

        def steps() -> int:
            if not held:
                return 0
            padded = np.concatenate([none, *held]).astype(PACKED)
            at = np.flatnonzero(np.concatenate([never, *dealt]) == round_)
            at = at[np.argsort(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
            for start in range(0, len(at), PIECE):
                piece = at[start : start + PIECE]
                who, *ways = vocabulary.forks(padded.take(piece))
                starts = range(0, len(piece), BATCH)
                ends = who.searchsorted([*starts, len(piece)]).tolist()
                for i, a, b in zip(starts, ends, ends[1:]):
                    network.learn(padded, piece[i : i + BATCH], vocabulary, (who[a:b] - i, *(x[a:b] for x in ways)))
            return len(at)

        for batch in batches:
            for ids in ids_of(batch.column(0), vocabulary, known):
                held += [ids, none]
                dealt += [rounds_of(ids, rounds), never]
                size += len(ids) + 2
                if size > 8 * STEP:
                    learnt += steps()
                    held, dealt, size = [], [], 0
        learnt += steps()
        if learnt:
            rows = network.rows().astype(np.float64) * learnt
            columns = {"row": pa.array(np.arange(len(rows)), pa.int32()), "n": pa.array(np.full(len(rows), learnt), pa.int64())}
            columns |= {f"x{d}": pa.array(rows[:, d]) for d in range(DIMENSIONS)}
            yield from pa.table(columns).to_batches(max_chunksize=5000)

    return train


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table of word counts."""
    ranked = counts.orderBy(F.desc("n"), "word").limit(WORDS)
    top = [(r["word"], r["n"]) for r in ranked.collect()]
    # At most WORDS rows.
    frequent = counts.sparkSession.createDataFrame(pa.table({"word": pa.array([w for w, _ in top], pa.string())}))
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).cast("int")
    rest = counts.join(F.broadcast(frequent), "word", "left_anti")
    others = np.zeros(BUCKETS)
    for r in rest.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        others[r["bucket"]] = r["n"]
    # Whole levels of counts, the highest first, of no more than RANKED words; there are 16 levels to a power of two.
    level, lowest, left = F.floor(F.log2("n") * 16), None, RANKED
    for at, words in sorted(rest.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= words
        if left < 0:
            break
        lowest = at
    pooled = rest.where(level >= lowest).collect() if lowest is not None else []
    return Vocabulary(top, others.tolist(), [(r["word"], r["n"]) for r in pooled])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network trained on all rows of ``texts``, whose one column has texts or packed ids."""
    network = Network(vocabulary.size)
    schema = "row int, n long, " + ", ".join(f"x{d} double" for d in range(DIMENSIONS))
    needed = vocabulary.without_words() if isinstance(texts.schema[0].dataType, BinaryType) else vocabulary
    for round_ in range(rounds if vocabulary.ids else 0):
        shared = texts.sparkSession.sparkContext.broadcast((needed, network))
        sums = texts.mapInArrow(_train_task(shared, round_, rounds), schema).groupBy("row")
        averages = [(F.sum(f"x{d}") / F.sum("n")).alias(f"x{d}") for d in range(DIMENSIONS)]
        rows = sums.agg(*averages).orderBy("row").toPandas()
        if len(rows):
            network = network.from_rows(rows.drop(columns="row").to_numpy(np.float32))
    return network


def encode_column(text: Column, vocabulary: Vocabulary) -> Column:
    """Struct of a text: ids (packed, two bytes each), n_tokens, less (what its pooled words have less than
    their buckets, but for the logs of the counts of ``pooled``), unigram (the log-probability without contexts,
    with ``less``), pooled (words that share buckets and are not ranked, and how often). Null and empty texts
    have no tokens."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocabulary.without_words(tables=True))

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = shared.value
        for batch in texts:
            none = vocabulary.encoded([], pa.array([], pa.large_string()).dictionary_encode())
            yield pa.concat_arrays([none, *(vocabulary.encoded(*found) for found in runs_of(batch))])

    encode.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    form = "ids binary, n_tokens long, less double, unigram double, pooled array<struct<word: string, n: bigint>>"
    return F.arrow_udf(encode, form)(text)


def score_column(ids: Column, vocabulary: Vocabulary, network: Network) -> Column:
    """The sum of the conditional log-probabilities of packed ids; zero without ids."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast((vocabulary.without_words(), network))

    def score(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, network = shared.value
        none = np.zeros(2, np.int64)
        for batch in packed:
            sums: list[np.ndarray] = []
            held: list[np.ndarray] = []
            size = 0

            def flush(held=held, sums=sums) -> None:
                if held:
                    # Two zeros behind each text; none is empty then.
                    logp = network.score(np.concatenate([none, *held]), vocabulary)
                    sums.append(np.add.reduceat(logp, np.cumsum([2, *map(len, held[:-1])])))
                    held.clear()

            for ids in ids_of(batch, vocabulary, {}):
                held.append(np.concatenate([ids, none]))
                size += len(ids)
                if size > STEP:
                    flush()
                    size = 0
            flush()
            yield pa.array(np.concatenate([np.zeros(0), *sums]), pa.float64())

    score.__annotations__ = {"packed": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(ids)


def own_counts(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """The logs of the corpus counts of the pooled words of every row, summed up. A word that the corpus
    does not have counts as seen once."""
    words = encoded.select("row", F.explode("pooled").alias("p")).select("row", "p.word", F.col("p.n").alias("times"))
    # Words seen once add nothing.
    known = counts.where(F.col("n") > 1)
    return words.join(known, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A line per row: doc_id, n_tokens, log_likelihood, per_token (null without tokens), unigram.

    Texts are read twice, to count words and to encode; what follows starts from the stored ids.
    """
    rows = id_and_text(docs, id_col, text_col)
    counts = stored(word_counts(rows), "words")
    vocabulary = build_vocabulary(counts)
    encoded = rows.select("doc_id", encode_column(F.col("text"), vocabulary).alias("s"))
    encoded = stored(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*"), "encoded")
    network = train(encoded.select("ids"), vocabulary)
    found = encoded.select(
        "row", "doc_id", "n_tokens", "unigram", (score_column(F.col("ids"), vocabulary, network) + F.col("less")).alias("log_likelihood")
    )
    more = F.coalesce("more", F.lit(0.0))
    added = [(F.col(c) + more).alias(c) for c in ("log_likelihood", "unigram")]
    scored = found.join(own_counts(encoded, counts), "row", "left").select("doc_id", "n_tokens", *added)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_likelihood", mean.alias("per_token"), "unigram")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
