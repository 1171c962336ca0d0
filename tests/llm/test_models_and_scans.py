"""Models by held-out results, tokens by the library's own, personal data and licences by small cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeops.llm import bpe, licenses, pii, pll, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_the_held_out_fold(spark):
    larger = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    scored = toxicity.op2_toxicity(spark, larger).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    assert right > 0.92 and all(0 <= r.score <= 1 for r in scored)


def test_toxicity_of_unseen_spellings():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ter", "nu", "sa"]) for _ in range(3))
    clean = [" ".join(word() for _ in range(40)) for _ in range(150)]
    bad = [" ".join([*t.split(), *rng.sample(["moronic", "morons", "moronish", "idiotic", "idiots"], 2)]) for t in clean]
    model = toxicity.train(clean + bad, [0] * 150 + [1] * 150)
    score = lambda t: model.score(t, {})
    assert score(clean[3] + " moronicc idiotix") > 0.5 > score(clean[3])
    assert score("") == model.score(" .,", {}) and np.array_equal(toxicity.train(clean + bad, [0] * 150 + [1] * 150).weights, model.weights)


def test_toxicity_learns_from_a_bounded_sample(spark, make, monkeypatch):
    """One row of an id, however often it repeats, and whole texts up to a number of code points."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: seen.append(list(zip(texts, marks))))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(60) if fold(i)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = make([(i, f"{i:02} " * 10) for i in range(60)] + [(ids[0], f"zz {n}") for n in range(3000)])
    toxicity.fit(docs, labels)
    assert sorted(seen.pop()) == sorted((f"{i:02} " * 10, i % 2) for i in ids)
    toxicity.fit(docs.unionAll(make([(ids[1], "!" * 500)])), labels, max_sample=(20, 10), max_chars=450)
    marks = [mark for text, mark in seen.pop() if len(text) == 30]
    assert marks.count(0) == 10 and marks.count(1) == 5
    three = make([(ids[0], "a" * 40), (ids[1], "b" * 41), (ids[2], None)])
    toxicity.fit(three, labels.where(F.col("doc_id").isin(ids[:3])), max_sample=(3, 3), max_chars=80)
    assert [text for text, _ in seen.pop()] == ["a" * 40]


def test_toxicity_scores_by_hand(spark, make):
    """The score of whole texts from the weights, n-gram by n-gram."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.3, -1.5)
    texts = ["", None, " .,", "One two two", "naïve ÉTÉ x", "w " * 5000 + "end", "a_b 12 12 12"]

    def by_hand(text):
        words = re.findall(r"\w+", (text or "").lower())
        if not words:
            return 1 / (1 + math.exp(1.5))
        total = weight = 0.0
        for word in set(words):
            marked = f"<{word}>"
            grams = [marked] + [marked[i : i + k] for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
            values = [float(model.weights[zlib.crc32(g.encode()) % toxicity.BUCKETS]) for g in grams]
            total += words.count(word) ** 0.5 * sum(values) / len(values)
            weight += words.count(word) ** 0.5
        return 1 / (1 + math.exp(0.3 - toxicity.SCALE * total / (toxicity.NEUTRAL + weight)))

    scored = make(list(enumerate(texts))).select("doc_id", toxicity.score_column(F.col("text"), model).alias("s"))
    assert {r.doc_id: pytest.approx(by_hand(texts[r.doc_id]), rel=1e-4) for r in scored.collect()} == dict(
        tuple(r) for r in scored.collect()
    )


def test_toxicity_without_labels_or_texts(spark, make):
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    docs = make([(1, "a"), (2, None), (None, "b"), (2, "c " * 50_000)])
    model = toxicity.fit(docs, labels)
    got = docs.select(toxicity.score_column(F.col("text"), model).alias("s")).collect()
    assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
    empty = toxicity.fit(make([]), labels.limit(0))
    assert make([]).select(toxicity.score_column(F.col("text"), empty)).count() == 0


# ------------------------------------------------------------------ pseudo-likelihood


def test_contexts_raise_the_likelihood(spark, tables):
    got = pll.score_documents(tables["documents"]).agg(F.sum("log_likelihood"), F.sum("unigram"), F.count("*")).first()
    assert got[0] > got[1] and got[2] == 1000


def test_word_and_class_probabilities_add_up():
    vocabulary = pll.Vocabulary([(f"w{i}", 1000 // (i + 1)) for i in range(300)], list(range(pll.BUCKETS)))
    of = np.bincount(vocabulary.of[1:], np.exp(vocabulary.inside[1:]), pll.CLASSES)
    assert np.allclose(of[of > 0], 1)
    network = pll.Network(vocabulary.size)
    ids = vocabulary.encode("w1 w2 w3, unknown w1", {})
    _, _, logp = network.forward(np.concatenate(([0, 0], ids, [0, 0])), np.arange(2, 2 + len(ids)))
    assert np.allclose(np.exp(logp).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(network.from_rows(network.rows()).e, network.e)


def test_a_swapped_word_costs_likelihood(spark, make):
    rows = [(i, "the cat sat on the mat . a dog lay in the sun . " * 30) for i in range(30)]
    got = {r.doc_id: r for r in pll.score_documents(make([*rows, (90, rows[0][1].replace("cat sat", "sat cat")), (91, None), (None, ""), (92, "the " * 70_000)])).collect()}
    assert got[90].log_likelihood < got[0].log_likelihood
    assert (got[91].n_tokens, got[91].log_likelihood, got[91].per_token) == (0, 0.0, None) and got[92].n_tokens == 70_000
    assert pll.score_documents(make([])).count() == 0


def test_pooled_words_have_their_own_counts(make, monkeypatch):
    monkeypatch.setattr(pll, "WORDS", 5)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(200))) for i in range(20)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (None, rows[1][1]), (21, "once only"), (22, None)]
    counts = Counter(w for _, t in rows for w in pll.tokens_of(t or ""))
    mass = sum(counts.values()) + pll.BUCKETS
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_tokens, r.unigram) for r in pll.score_documents(make(rows)).collect()), key=key)
    for (i, n, unigram), (k, t) in zip(got, sorted(rows, key=key), strict=True):
        words = pll.tokens_of(t or "")
        assert (i, n) == (k, len(words)) and np.isclose(unigram, sum(np.log(counts[w] / mass) for w in words))


def test_likelihood_token_by_token(make, monkeypatch):
    monkeypatch.setattr(pll, "WORDS", 40)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(300)))) for i in range(25)]
    rows += [(25, "w1"), (26, ""), (27, None), (27, "w1 never")]
    made = {}
    train, build = pll.train, pll.build_vocabulary
    monkeypatch.setattr(pll, "build_vocabulary", lambda counts: made.setdefault("v", build(counts)))
    monkeypatch.setattr(pll, "train", lambda *x: made.setdefault("n", train(*x)))
    got = sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in pll.score_documents(make(rows)).collect())
    v, net = made["v"], made["n"]
    counts = Counter(w for _, t in rows for w in pll.tokens_of(t or ""))

    def log_p(words, i):
        ids = [v.ids.get(w) or v.first + zlib.crc32(w.encode()) % pll.BUCKETS for w in words]
        around = [ids[i + s] if 0 <= i + s < len(ids) else 0 for s in pll.SIDES]
        h = np.tanh(sum(net.e[a].astype(float) * net.p[k] for k, a in enumerate(around)))
        logits = h @ net.u + net.b
        out = logits[v.of[ids[i]]] - np.log(np.exp(logits).sum())
        start = v.starts[ids[i]]
        for fork, turn in zip(v.paths[start : start + v.lengths[ids[i]]], v.turns[start : start + v.lengths[ids[i]]]):
            out -= np.log1p(np.exp(-turn * (h @ net.v[fork] + v.odds[fork])))
        if ids[i] >= v.first:  # the word's share of its bucket, which has one more than its words
            bucket = sum(n for w, n in counts.items() if w not in v.ids and zlib.crc32(w.encode()) % pll.BUCKETS == ids[i] - v.first)
            out += np.log(counts[words[i]] / (bucket + 1))
        return out

    want = []
    for i, text in rows:
        words = pll.tokens_of(text or "")
        want.append((i, len(words), sum(log_p(words, k) for k in range(len(words)))))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-4, atol=1e-3)


def test_runs_between_white_space_are_cut_into_words_once(make, monkeypatch):
    """Counts, ids and pooled words equal those of whole texts, whatever is remembered and ranked."""
    cut, plain = Counter(), pll.words_of
    monkeypatch.setattr(pll, "words_of", lambda run: cut.update([run]) or plain(run))
    odd = ["It's (a) it's\x1c\x85b_c\u3000É! Straße\tİ ²½ " * 40, "漢字かな。" * 30, "_x_ x_ -- ...a" * 20, " \n", "", None, "x" * 90 + " it's"]
    rows = list(enumerate([*odd, *odd]))
    want = Counter(w for _, t in rows for w in pll.tokens_of(t or ""))
    encoded = lambda v, t, known: b"".join(v.packed(t or "", known)[0])
    vocabulary = pll.Vocabulary([("it", 9), ("a", 5)], [1] * pll.BUCKETS, [("s", 4)])
    known = {}
    for _, text in rows:
        words = pll.tokens_of(text or "")
        ids = [vocabulary.ids.get(w) or vocabulary.first + zlib.crc32(w.encode()) % pll.BUCKETS for w in words]
        packed, pooled, own = vocabulary.packed(text or "", known)
        assert np.frombuffer(b"".join(packed), pll.PACKED).tolist() == ids == vocabulary.encode(text or "", {}).tolist()
        assert [w for ws in pooled for w in ws] == [w for w in words if w not in ("it", "a", "s")]
        assert np.isclose(sum(own), words.count("s") * math.log(4))
    # It is there 82 times: once for the table of all texts, once for that of each text.
    assert cut["it's"] <= 1 + len(rows)
    for runs, chars in ((pll.MAX_RUNS, pll.MAX_CHARS), (3, pll.MAX_CHARS), (pll.MAX_RUNS, 30)):
        monkeypatch.setattr(pll, "MAX_RUNS", runs)
        monkeypatch.setattr(pll, "MAX_CHARS", chars)
        assert {r.word: r.n for r in pll.word_counts(make(rows)).collect()} == want
        known = {}
        assert all(encoded(vocabulary, t, known) == encoded(vocabulary, t, {}) and len(known) <= runs for _, t in rows)


def test_texts_are_encoded_many_at_a_time(make, monkeypatch):
    """Distinct runs of many texts are cut once; each text gets what it gets by itself."""
    odd = ["It's (a) it's\x1c\x85b_c\u3000E! Straße\tİ ²½ " * 40, "漢字かな。" * 30, "_x_ x_ -- ...a" * 20, " \n", "", None, "x" * 90 + " it's", "s s. a"]
    texts = pa.array([*odd, *odd], pa.string())
    vocabulary = pll.Vocabulary([("it", 9), ("a", 5)], [1] * pll.BUCKETS, [("s", 4)])
    pooled = lambda t: Counter(w for w in pll.tokens_of(t or "") if w not in ("it", "a", "s"))
    for chars, found in ((pll.MAX_CHARS, pll.MAX_FOUND), (30, pll.MAX_FOUND), (pll.MAX_CHARS, 0)):
        monkeypatch.setattr(pll, "MAX_CHARS", chars)
        monkeypatch.setattr(pll, "MAX_FOUND", found)
        pieces = list(pll.runs_of(texts))
        assert len(pieces) > 1 or (chars > 30 and found)
        assert all(len(set(runs.dictionary.to_pylist())) == len(runs.dictionary) for _, runs in pieces)
        for v in (vocabulary, vocabulary.without_words(tables=True)):
            rows = [row for piece in pieces for row in v.encoded(*piece).to_pylist()]
            assert len(rows) == len(texts)
            for row, text in zip(rows, [*odd, *odd]):
                packed, _, own = vocabulary.packed(text or "", {})
                ids = np.frombuffer(b"".join(packed), pll.PACKED)
                less = vocabulary.pooled[ids].sum() + sum(own)
                assert (row["ids"], row["n_tokens"]) == (b"".join(packed), len(ids))
                assert np.allclose([row["less"], row["unigram"]], [less, vocabulary.unigram[ids].sum() + less])
                assert {p["word"]: p["n"] for p in row["pooled"]} == pooled(text)
    rows = make([(i, t) for i, t in enumerate(texts.to_pylist())]).select(pll.encode_column(F.col("text"), vocabulary).alias("s")).collect()
    assert sorted(r.s.n_tokens for r in rows) == sorted(len(pll.tokens_of(t or "")) for t in texts.to_pylist())


def test_steps_equal_sums_row_by_row():
    """One gradient step beside sums token by token and fork by fork; rows and forks repeat."""
    vocabulary = pll.Vocabulary([(f"w{i}", 1000 // (i + 1)) for i in range(300)], [1] * pll.BUCKETS)
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 200), vocabulary.size - 1)
    padded, at = np.concatenate(([0, 0], ids, [0, 0])), np.arange(2, 202)
    network = pll.Network(vocabulary.size)
    network.u += rng.normal(0, 0.5, network.u.shape).astype(np.float32)
    network.v += rng.normal(0, 0.5, network.v.shape).astype(np.float32)
    e, p, u, b, v = (x.astype(float) for x in (network.e, network.p, network.u, network.b, network.v))
    to_e, to_p, to_u, to_b, to_v = (np.zeros_like(x) for x in (e, p, u, b, v))
    seen, forked = Counter(), Counter()
    for i in at:
        around = [padded[i + s] for s in pll.SIDES]
        h = np.tanh(sum(e[a] * p[k] for k, a in enumerate(around)))
        g = np.exp(h @ u + b)
        g /= g.sum()
        g[vocabulary.of[padded[i]]] -= 1
        to_h = u @ g
        to_u += np.outer(h, g)
        to_b += g
        start = vocabulary.starts[padded[i]]
        for fork, turn in zip(vocabulary.paths[start:], vocabulary.turns[start : start + vocabulary.lengths[padded[i]]]):
            wrong = -turn / (1 + np.exp(turn * (h @ v[fork] + vocabulary.odds[fork])))
            to_h = to_h + wrong * v[fork]
            to_v[fork] += wrong * h
            forked[fork] += 1
        for k, a in enumerate(around):
            to_e[a] += to_h * (1 - h * h) * p[k]
            to_p[k] += to_h * (1 - h * h) * e[a]
            seen[a] += 1
    network.learn(padded, at, vocabulary)
    n, rate = len(at), pll.RATE / len(at)
    for fork, times in forked.items():
        v[fork] -= rate * to_v[fork] * n / max(times, 8)
    for a, times in seen.items():
        e[a] -= np.clip(rate * to_e[a] * n / max(times, 8), -0.5, 0.5)
    e[0] = 0
    expected = (e, p - rate * to_p, u - 4 * rate * to_u, b - 4 * rate * to_b, v)
    for got, x in zip((network.e, network.p, network.u, network.b, network.v), expected):
        assert np.allclose(got, x, atol=1e-5)


def test_only_unranked_pooled_words_are_joined(make, monkeypatch):
    """Words whose counts all tasks have leave the join; the likelihoods are the same."""
    monkeypatch.setattr(pll, "WORDS", 5)
    monkeypatch.setattr(pll, "train", lambda texts, vocabulary: pll.Network(vocabulary.size))
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}." for _ in range(100))) for i in range(12)]
    join, sent, found = pll.own_counts, [], []
    monkeypatch.setattr(pll, "own_counts", lambda encoded, counts: sent.append(encoded.agg(F.sum(F.size("pooled"))).first()[0]) or join(encoded, counts))
    for ranked in (0, 20, 10_000):
        monkeypatch.setattr(pll, "RANKED", ranked)
        scored = pll.score_documents(make(rows)).collect()
        found.append({r.doc_id: pytest.approx((r.n_tokens, r.log_likelihood, r.unigram), rel=1e-6) for r in scored})
    first = {r.doc_id: (r.n_tokens, r.log_likelihood, r.unigram) for r in scored}
    assert found[0] == first and found[1] == first and sent[0] > sent[1] > sent[2] == 0


def test_every_token_is_predicted_in_one_round(monkeypatch):
    vocabulary = pll.Vocabulary([(f"w{i}", 1000 // (i + 1)) for i in range(300)], [0] * pll.BUCKETS)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (0, 1, 900, 40)]
    seen = Counter()
    monkeypatch.setattr(pll.Network, "learn", lambda self, padded, at, *_: seen.update(padded[at].tolist()))
    shared = SimpleNamespace(value=(vocabulary, pll.Network(vocabulary.size)))
    for round_ in range(pll.ROUNDS):
        list(pll._train_task(shared, round_, pll.ROUNDS)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert seen == Counter(int(i) for t in texts for i in vocabulary.encode(t, {}))


def test_words_of_a_class_depend_on_the_context():
    # Pairs of words of one frequency: behind "left" comes always the one, behind "right" the other.
    words = [(w, 100) for w in ("left", "right", *(f"{c}{k}" for k in range(150) for c in "ab"))]
    vocabulary = pll.Vocabulary(words, [0] * pll.BUCKETS)
    a, b = next((f"a{k}", f"b{k}") for k in range(150) if vocabulary.of[vocabulary.ids[f"a{k}"]] == vocabulary.of[vocabulary.ids[f"b{k}"]])
    ids = vocabulary.encode(f"left {a} . right {b} . " * 2000, {})
    network, padded = pll.Network(vocabulary.size), np.concatenate(([0, 0], ids, [0, 0]))
    places = np.random.default_rng(0).permutation(np.arange(2, len(padded) - 2))
    for i in range(0, len(places), pll.BATCH):
        network.learn(padded, places[i : i + pll.BATCH], vocabulary)
    logp = lambda text: network.score(np.concatenate(([0, 0], vocabulary.encode(text, {}), [0, 0])), vocabulary)[3]
    of_class = lambda text: network.forward(np.concatenate(([0, 0], vocabulary.encode(text, {}), [0, 0])), np.array([3]))[2][0]
    inside = lambda text, w: logp(text) - of_class(text)[vocabulary.of[vocabulary.ids[w]]]
    assert inside(f"left {a} .", a) - inside(f"left {b} .", b) > inside(f"right {a} .", a) - inside(f"right {b} .", b) + 0.1
    # All words of a class together have its probability, in any context.
    one = [w for w in vocabulary.ids if vocabulary.of[vocabulary.ids[w]] == vocabulary.of[vocabulary.ids[a]]]
    others = vocabulary.first + np.flatnonzero(vocabulary.of[vocabulary.first :] == vocabulary.of[vocabulary.ids[a]])
    around = vocabulary.encode("left x .", {})
    total = sum(
        np.exp(network.score(np.array([0, 0, around[0], i, around[2], 0, 0]), vocabulary)[3])
        for i in [*(vocabulary.ids[w] for w in one), *others]
    )
    assert np.isclose(total, np.exp(of_class(f"left {a} .")[vocabulary.of[vocabulary.ids[a]]]), atol=1e-4)


# ------------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library(tokens):
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens) if t}
    return tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_tokens_are_the_librarys(tokens, library, tables, monkeypatch):
    rng = random.Random(1)
    alphabets = ["ab", "aaab ", "abcdefghij", "日本語はé ñß🙂", "etaoin srhl", "01 \n\t", "=-_*. ", "  x \r\n"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([3, 20, 300]))) for _ in range(800)]
    texts += [r.text or "" for r in tables["documents"].select("text").collect()]
    texts += ["", " ", "  ", "a" * 50_000, "it's we'll  don't", "<|endoftext|>"]
    for limits in ({}, {"MAX_STATES": 50, "MAX_PIECES": 5, "MAX_CHUNKS": 5, "MAX_PAIRS": 20, "STEP": 16}):
        for name, value in limits.items():
            monkeypatch.setattr(bpe, name, value)
        encoder = bpe.Encoder(tokens, bpe.split_pattern())
        decoder = bpe.Decoder(tokens)
        for text in texts[:900] if limits else texts:
            ids = encoder.encode(text)
            assert ids == packed(library.encode_ordinary(text)), text
            assert decoder.text(ids) == text


def test_steps_look_at_live_boundaries_only(tokens, library, monkeypatch):
    """A step looks up bytes only from the boundaries from which a token may go on; letters need no pattern."""
    encoder = bpe.Encoder(tokens, bpe.split_pattern())
    transducer, rng = encoder.transducer, random.Random(8)
    words = ["".join(rng.choice(["th", "is", "er", "an", "on", "qu", "x", "ing"]) for _ in range(rng.randrange(1, 8))) for _ in range(800)]
    monkeypatch.setattr(encoder, "matches", lambda text: pytest.fail(text))
    for word in words:
        assert encoder.chunk(word) == struct.pack(f"<{len(ids := library.encode_ordinary(' ' + word))}I", *ids)
    assert not encoder.known and len(encoder.after_blank) == len(set(words))
    longer = {t[:k] for t in tokens for k in range(len(t))}
    assert len(transducer.content) > 1000
    for key, ending, live in transducer.content:
        data = key[4:]
        assert key[:4] == (struct.pack("<I", ending[0]) if ending[0] >= 0 else bpe.NONE)
        assert len(ending) == len(data) + 1 and live == tuple(at for at in range(len(data) + 1) if data[at:] in longer)


def test_stream_of_bytes_in_any_pieces():
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choice(["a", "é", "語", "🙂"]) for _ in range(20)).encode()
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            size = rng.randrange(1, 4)
            out += stream.feed(data[at : at + size])
            at += size
        assert out + stream.feed(b"", last=True) == data.decode() and stream.bad == 0
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xe8\xaa") == "a" and broken.feed(b"", last=True) == "�" and broken.bad == 1


def test_encoded_documents(spark, make, library):
    rows = [(1, "Hello  world"), (2, None), (None, ""), (2, "x" * 200_000)]
    got = make(rows).select("doc_id", bpe.round_trip_column(F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    want = [(i or -1, packed(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        (i, len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(b).hexdigest()) for i, p, b in want
    )
    there = make(rows).select(bpe.encode_column(F.col("text")).alias("ids")).select(bpe.decode_column(F.col("ids")).alias("t"))
    assert sorted(r.t for r in there.collect()) == sorted(t or "" for _, t in rows)
    assert make([]).select(bpe.round_trip_column(F.col("text"))).count() == 0


# ------------------------------------------------------------------ personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    def luhn(number):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_base_spans_against_plain_patterns(make):
    rng = random.Random(6)
    pieces = ["a@b.c", "x.y@z-1.com", "_d@e.f", "1.2.3.4", "999.1.1.1", ".5", "4111 1111 1111 1111", "4570364245126885", "+1 (556) 555-9070", "+12", "-", " ", "é", "@", "7", "0255"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "x" * 20_000 + "@" + "a." * 3000 + "a b@c.d", "4111111111111111-", "1." * 9000]
    got = {r.doc_id: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r.base] for r in pii.find_personal_data(make(enumerate(texts))).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_contexts_find_unseen_identifiers(make):
    rows = [(i, f"text {i} mailto: user{i}@mail.example and so on") for i in range(20)]
    rows += [(30, "mailto: user_31(at)mail222.example ok"), (31, "see user_32(at)mail333.example"), (31, "see user_32(at)mail333.example"), (None, None)]
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.found] for r in pii.find_personal_data(make(rows)).collect()}
    assert got[30] == [(0, 8, 34)] and got[31] == [] and got[3] == [(0, 15, 33)]
    assert pii.find_personal_data(make([])).count() == 0


def test_chains_of_contexts_are_followed_to_their_end(spark):
    edges = [("w0", "i0", 0), *((f"w{k}", f"i{k + j}", None) for k in range(6) for j in (0, 1) if k + j)]
    trusted = pii.trusted_patterns(spark.createDataFrame(edges, "word string, instance string, kind int"), 0.5, 1)
    assert {(r.word, r.kind) for r in trusted.collect()} == {(f"w{k}", 0) for k in range(6)}


# ------------------------------------------------------------------ licences


def test_licences_by_sentences_and_rules(make):
    mit = (
        "Copyright 2024 Someone.\nPermission is hereby granted, free of charge, to any person obtaining a copy of it. "
        "The above copyright notice and this permission notice shall be included in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY.'
    )
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
        "1. Redistributions of source code must retain the above copyright notice.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice.\n"
    )
    rows = [
        (1, "Some prose. Licensed under the Apache License, Version 2.0. More."),
        (2, mit),
        (3, bsd + "This software is provided as is."),
        (4, bsd + "3. Neither the name of X may be used to endorse or promote products.\nThis software is provided as is."),
        (5, "The licence of the poet.\nAll rights reserved."),
        (6, "Licensed under the GNU General Public License, version 3.\nat your option, any later version."),
        (7, None), (7, ""), (None, "Released under the MIT License." + " word" * 50_000),
    ]
    got = {}
    for r in licenses.scan_licenses(make(rows), result_col="kept").collect():
        got.setdefault(r.doc_id, []).append((r.kept.licenses, r.kept.n_unmatched))
    assert got == {
        1: [(["Apache-2.0"], 0)], 2: [(["MIT"], 1)], 3: [(["BSD-2-Clause"], 0)], 4: [(["BSD-3-Clause"], 0)],
        5: [(["Proprietary"], 0)], 6: [(["GPL-3.0-or-later"], 0)], 7: [([], 0)] * 2, None: [(["MIT"], 0)],
    }
    assert licenses.scan_licenses(make([])).count() == 0


def test_standard_licence_headers(make):
    gpl = (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n"
        "(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
    )
    mpl = (
        "This Source Code Form is subject to the terms of the Mozilla Public\n"
        "License, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one there."
    )
    want = {
        1: ("SPDX-License-Identifier: MIT", ["MIT"], 0),
        2: ("// SPDX-License-Identifier: (GPL-2.0-or-later OR mit)\nimport x", ["GPL-2.0-or-later", "MIT"], 0),
        3: ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", ["GPL-2.0"], 0),
        4: ("<!-- SPDX-License-Identifier: Zlib -->", ["Zlib"], 0),
        5: (mpl, ["MPL-2.0"], 0),
        6: ("Eclipse Public License v2.0", ["EPL-2.0"], 0),
        7: ("Made available under the Eclipse Public License, v2.", ["EPL-2.0"], 0),
        8: (gpl, ["GPL-3.0-or-later"], 0),
        9: ("/*\n * " + gpl.replace("\n", "\n * ") + "\n */", ["GPL-3.0-or-later"], 0),
        10: (gpl.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), ["LGPL-2.1-or-later"], 0),
        11: ("Copyright (c) 2024 Someone\nAll rights reserved.", ["Proprietary"], 0),
        12: ("Licensed under the Apache License, v. 2.0.", ["Apache-2.0"], 0),
        13: ("It was released into the public\ndomain.", ["Public-Domain"], 0),
    }
    got = licenses.scan_licenses(make([(i, t) for i, (t, _, _) in want.items()]), result_col="kept").collect()
    assert {r.doc_id: (r.kept.licenses, r.kept.n_unmatched) for r in got} == {i: (x, n) for i, (_, x, n) in want.items()}
