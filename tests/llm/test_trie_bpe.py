"""Trie BPE beside the tokenizer library."""

import copy
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from __spark_entry__ import queries
from lakeops.llm import trie_bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ALPHABET = "aaaabbbccde  the'sll've'm're'd123 \n\t.,!?-éüßİΣςσ漢字ñ́̇\x85\xa0​\x1c😀ǅ²½Ⅷ\x00\x7f<|endoftext|>"
ODD = [
    "", "   ", "\n", "a", "a" * 5000, "aab" * 300, "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|", "it's I'LL we'reve ''s 's",
    "ÉTÉ Straße İstanbul ΣΑΣ", "é ä́", "\x1c\x1d", "漢字かな 12३४", "𝒜𝓑", "﻿abc", "</w> a</w>b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return json.load(file)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def texts(seed, n=300):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]
    spans = [(0, 0x300), (0, 0x3000), (0x3000, 0xD800), (0xE000, 0x110000)]
    return made + ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(30)) for _ in range(n)]


def check(encoder, library, rows):
    for text, parts in zip(rows, encoder.encode(rows), strict=True):
        ids, decoded = expected(library, text)
        assert np.frombuffer(b"".join(i for i, _ in parts), "<u4").tolist() == ids, text[:80]
        assert b" ".join(d for i, d in parts if i).decode() == decoded, text[:80]


def test_texts_equal_the_library(library, spec):
    encoder = trie_bpe.Encoder(spec)
    check(encoder, library, ODD)
    check(encoder, library, texts(1))


def test_small_tables_and_cuts(library, spec, monkeypatch):
    """Results do not depend on the slices, on forgotten words or on where long texts are cut."""
    monkeypatch.setattr(trie_bpe, "STEP", 50)
    monkeypatch.setattr(trie_bpe, "MAX_WORDS", 7)
    monkeypatch.setattr(trie_bpe, "MAX_PAIRS", 20)
    long = [" ".join(texts(3, 40)), "word " * 200, " " * 500, "x" * 300, "<|endoftext|> " * 30]
    check(trie_bpe.Encoder(spec), library, [*ODD, *texts(2, 60), *long])


def test_trie_shares_prefixes(spec):
    encoder = trie_bpe.Encoder(spec)
    words = {"an", "and", "ands", "andes", "b", "n"}
    trie = trie_bpe.Trie(words)
    # a, an, and, ande as inner nodes; a leaf for each word.
    assert trie.nodes() == 4 + 6
    assert set(trie.encode(encoder.merges)) == words
    rng = random.Random(4)
    many = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(2000)}
    found = trie_bpe.Trie(many).encode(encoder.merges)
    for word in many:
        symbols = [encoder.merges.plain[c] for c in word[:-1]] + [encoder.merges.final[word[-1]]]
        assert found[word] == encoder.merges.merged(symbols)


def test_query_equals_the_library(spark, library):
    found = {r.doc_id: r for r in queries()["op12_trie_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids, decoded = expected(library, row.text or "")
        got = found[row.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_columns_round_trip(spark, make, library):
    rows = [(i, t) for i, t in enumerate([*ODD, *texts(5, 20)])] + [(None, None), (1, "again"), (1, "again")]
    docs = make(rows).withColumn("ids", trie_bpe.encode_column(F.col("text")))
    assert docs.columns[:5] == ["doc_id", "text", "kept", "n_words", "a.b"]
    for r in docs.select("text", "ids", trie_bpe.decode_column(F.col("ids")).alias("decoded")).collect():
        ids, decoded = expected(library, r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == decoded
    assert make([]).select(trie_bpe.round_trip_column(F.col("text"))).collect() == []
    nothing = make([(1, None)]).select(trie_bpe.round_trip_column(F.col("text")).alias("r")).first().r
    assert nothing.n_tokens == 0 and nothing.ids_sha256 == nothing.decoded_sha256 == hashlib.sha256().hexdigest()


def test_other_files_are_refused(spec):
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}]}}):
        with pytest.raises(ValueError):
            trie_bpe.Encoder({**copy.deepcopy(spec), **change})
