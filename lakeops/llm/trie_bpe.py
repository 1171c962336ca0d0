"""BPE with word ends, encoded over a trie of the distinct words, and decoded again.

**Encoding.** Every prefix of a word has one encoding without its word end. Its last token is
enough to know it: the tokens before are the encoding of the prefix that this token leaves over. So
the state of a trie node is one token, found among the tokens that end at the node as the only one
that may stand beside the state of the node where it begins. Words that share a prefix share its
nodes, and each node is worked out once. The last symbol of a word carries the word's end; it is a
leaf of its own below the last node.

The distinct words of a slice of texts, sorted, *are* their trie: a word adds a node for each prefix
that is longer than what it shares with the word before it. Walking the words in this order is the
depth-first traversal; the states on the path from the root are a stack.

Words are remembered in a table of bounded size, so that a slice inserts only those it brings in.

**Decoding.** Tokens of the vocabulary, a blank between each two, as for a tokenizer without decoder.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import named, table

VOCABULARY = "word_bpe_49k.json"
# Code points of texts whose words are looked up together.
STEP = 1 << 22
# What a generation of remembered words and the table of neighbouring tokens may hold.
MAX_WORDS = 400_000
MAX_PAIRS = 1_000_000

# What the vocabulary's file says about its normaliser and its pattern of words.
WHITE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, WHITE, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# The pattern over texts whose letters and digits beyond ASCII are written as ``z`` and ``0``, and
# other characters beyond ASCII as ``.``.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^ A-Za-z0-9]+")
# Texts without these are normalised by lower-casing alone: white space and case folding of Python and
# of the tokenizer agree on what is left, and nothing of it composes.
UNUSUAL = re.compile("[\x1c-\x1f̀-\U0010ffff]")


def byte_symbols() -> dict[int, str]:
    """The character that stands for a byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(unseen)}


class Merges:
    """Tokens and merges of a vocabulary, and which tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.text = {i: t for t, i in vocabulary.items()}
        self.word_end = word_end
        self.plain = {t: i for t, i in vocabulary.items() if not t.endswith(word_end)}
        self.final = {t.removesuffix(word_end): i for t, i in vocabulary.items() if t.endswith(word_end)}
        self.size = {i: len(t.removesuffix(word_end)) for t, i in vocabulary.items()}
        # Everything that begins a token: the token if it is a whole one without word end, else -1.
        self.begins = {t.removesuffix(word_end)[:k]: -1 for t in vocabulary for k in range(1, len(t))}
        self.begins |= self.plain
        self.made: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.across: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            token, pair = vocabulary[left + right], (vocabulary[left], vocabulary[right])
            parts = [i for i in pair if self.size[i] > 1]
            if token in self.made or any(i not in self.made for i in parts):
                raise ValueError(f"merge {rank} makes a token again or uses one that is not made yet")
            self.made[token], self.rank[token], self.across[pair] = pair, rank, rank
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE: the merge of least rank, leftmost first, until none is left."""
        none = len(self.across)
        while len(symbols) > 1:
            ranks = [self.across.get(pair, none) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            symbols[at : at + 2] = [self.plain_or_final(symbols[at], symbols[at + 1])]
        return symbols

    def plain_or_final(self, left: int, right: int) -> int:
        both = self.text[left] + self.text[right]
        bare = both.removesuffix(self.word_end)
        return self.plain[both] if bare == both else self.final[bare]

    def merges_to_itself(self, token: int) -> bool:
        """Whether the symbols of a token merge into it."""
        known = self.own.get(token)
        if known is None:
            text = self.text[token]
            bare = text.removesuffix(self.word_end)
            last = self.plain if bare == text else self.final
            known = self.merged([*(self.plain[c] for c in bare[:-1]), last[bare[-1]]]) == [token]
            self.own[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay side by side; ``left`` is -1 at the beginning of a word.

        Merges happen in the order of their ranks, so undoing the later one of the two tokens at a
        time gives each pair that ever faced each other, and the rank before which it had to merge.
        Of equal ranks the merge further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        known = self.merges_to_itself(right)
        if known and left >= 0:
            x, y, limit = left, right, len(self.across)
            while True:
                across = self.across.get((x, y))
                if across is not None and across < limit:
                    known = False
                    break
                x_rank, y_rank = self.rank.get(x, -1), self.rank.get(y, -1)
                if x_rank < 0 and y_rank < 0:
                    break
                if x_rank > y_rank:
                    limit, x = x_rank, self.made[x][1]
                else:
                    limit, y = y_rank + 1, self.made[y][0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known


class Trie:
    """Distinct words in sorted order; ``shared[k]`` is the depth of the node at which word ``k``
    leaves the path of the word before it. The last symbol of a word is not a node."""

    def __init__(self, words: set[str]):
        self.words = sorted(words)
        self.shared = []
        before = ""
        for word in self.words:
            most = min(len(before), len(word)) - 1
            depth = 0
            while depth < most and before[depth] == word[depth]:
                depth += 1
            self.shared.append(depth)
            before = word

    def nodes(self) -> int:
        """Nodes below the root, leaves included."""
        return sum(len(word) - shared for word, shared in zip(self.words, self.shared))

    def encode(self, merges: Merges) -> dict[str, list[int]]:
        """The ids of every word, by one depth-first traversal.

        Of the nodes on the current path, ``last`` holds the state, the last token of the prefix's
        encoding, and ``begun`` the depths at which a token may have begun that goes on.
        """
        begins, final, size = merges.begins, merges.final, merges.size
        pairs, fits = merges.pairs, merges.fits
        last, begun = [-1], [[0]]
        out = {}
        for word, shared in zip(self.words, self.shared):
            del last[shared + 1 :], begun[shared + 1 :]
            end = len(word)
            for depth in range(shared + 1, end):
                state, alive = -1, []
                for at in begun[-1]:
                    token = begins.get(word[at:depth])
                    if token is not None:
                        alive.append(at)
                        if token >= 0 > state:
                            left = last[at]
                            known = pairs.get((left, token))
                            if known or (known is None and fits(left, token)):
                                state = token
                if state < 0:
                    raise AssertionError("a prefix without an encoding")
                alive.append(depth)
                last.append(state)
                begun.append(alive)
            for at in begun[-1]:
                token = final.get(word[at:])
                if token is not None and fits(last[at], token):
                    break
            else:
                raise AssertionError("a word without an encoding")
            ids = [token]
            while at:
                token = last[at]
                ids.append(token)
                at -= size[token]
            out[word] = ids[::-1]
        return out


class Encoder:
    """Texts to ids and decoded texts. ``spec`` is the tokenizer file's content."""

    def __init__(self, spec: dict):
        import tokenizers

        check_supported(spec)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")
        self.symbols = {b: s for b, s in byte_symbols().items() if chr(b) != s}
        self.normalise = tokenizers.Tokenizer.from_str(json.dumps(spec)).normalizer.normalize_str
        regex, replace = tokenizers.Regex, tokenizers.normalizers.Replace
        self.letter = replace(regex(r"\p{L}"), "").normalize_str
        self.digit = replace(regex(r"\p{N}"), "").normalize_str
        self.kinds: dict[int, str] = {}
        self.usual_words = self.pattern(map(chr, range(0x80, 0x300)))
        self.texts = {i: t.encode() for i, t in self.merges.text.items()}
        self.texts |= {i: t.encode() for t, i in self.special.items()}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def pattern(self, others) -> re.Pattern:
        """The pattern of words over ASCII and the given characters, none of which needs folding."""
        kinds: dict[str, str] = {"z": "", "0": "", ".": "", " ": ""}
        for c in others:
            kinds[" " if c.isspace() else self.kind_of(c)] += c
        letters, digits = "A-Za-z" + kinds["z"], "0-9" + kinds["0"]
        white = r"\t-\r " + kinds[" "]
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{white}{letters}{digits}]+")

    def kind_of(self, c: str) -> str:
        return "z" if not self.letter(c) else "0" if not self.digit(c) else "."

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not UNUSUAL.search(text):
            return self.usual_words.findall(text.lower())
        text, kinds = self.normalise(text), self.kinds
        for c in set(text):
            if c >= "\x80" and ord(c) not in kinds:
                kinds[ord(c)] = self.kind_of(c)
        return [text[m.start() : m.end()] for m in PLAIN_WORDS.finditer(text.translate(kinds))]

    def words_and_special(self, text: str) -> list[str]:
        """The words of a text; a special token is one with a blank in front."""
        if "<" not in text or not self.special_pattern.search(text):
            return self.words(text)
        at, found = 0, []
        for match in self.special_pattern.finditer(text):
            found += self.words(text[at : match.start()])
            found.append(" " + match.group())
            at = match.end()
        return found + self.words(text[at:])

    def learn(self, words: set[str]) -> None:
        """Enters ids and decoded bytes of words that are not known yet."""
        special = {w for w in words if w[0] == " "}
        for w in special:
            self.known[w] = packed([self.special[w[1:]]]), w[1:].encode()
        seen = {w: self.as_symbols(w) for w in words - special}
        ids, texts = Trie(set(seen.values())).encode(self.merges), self.texts
        for w, symbols in seen.items():
            row = ids[symbols]
            self.known[w] = packed(row), b" ".join([texts[i] for i in row])

    def as_symbols(self, word: str) -> str:
        """The word's bytes, each as the character that stands for it."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.symbols)

    def lookup(self, lists: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of every list of words; unknown words are learnt together.

        Words are remembered in two generations: when the younger one is full it becomes the older,
        and a word that is met again moves to the younger."""
        words = set().union(*lists)
        missing = words.difference(self.known)
        if missing and len(self.known) + len(missing) > MAX_WORDS:
            self.older, self.known, missing = self.known, {}, words
        unknown = missing.difference(self.older)
        for word in missing - unknown:
            self.known[word] = self.older[word]
        if unknown:
            self.learn(unknown)
        known = self.known
        for row in lists:
            found = [known[w] for w in row]
            yield b"".join([ids for ids, _ in found]), b" ".join([text for _, text in found])

    def encode(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each text, in order: its parts as packed ids and decoded bytes. Texts are taken in
        slices of ``STEP`` code points; longer ones are cut at blanks into parts."""
        waiting, size = [], 0
        for text in texts:
            if size + len(text) > STEP and waiting:
                yield from ([found] for found in self.lookup(waiting))
                waiting, size = [], 0
            if len(text) > STEP:
                yield [found for part in cuts(text) for found in self.lookup([self.words_and_special(part)])]
                continue
            waiting.append(self.words_and_special(text))
            size += len(text)
        if waiting:
            yield from ([found] for found in self.lookup(waiting))


def cuts(text: str) -> Iterator[str]:
    """A text in parts of ``STEP`` code points or more, cut before a blank: no word, no special token
    and nothing that composes reaches over it."""
    start = 0
    while start < len(text):
        cut = text.find(" ", start + STEP)
        cut = len(text) if cut < 0 else cut
        yield text[start:cut]
        start = cut


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes() if len(ids) > 16 else array("I", ids).tobytes()


def check_supported(spec: dict) -> None:
    """Refuses files whose settings this encoder does not follow."""
    model = spec["model"]
    supported = {
        "normalizer": spec["normalizer"] == NORMALIZER,
        "pre_tokenizer": spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]},
        "decoder": spec["decoder"] is None,
        "model": model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"],
        "model settings": not (model["dropout"] or model["byte_fallback"] or model["ignore_merges"]),
        "added_tokens": not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    refused = [name for name, fine in supported.items() if not fine]
    if refused:
        raise ValueError(f"this tokenizer file is of another kind: {', '.join(refused)}")


class Vocabulary:
    """The tokenizer file for all tasks. A worker that is used again keeps its tables."""

    def __init__(self, content: str):
        self.content, self.made = content, None

    def __getstate__(self):
        return {"content": self.content, "made": None}

    def encoder(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(json.loads(self.content))
        return self.made


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _column(function, path: str | None, kind: str, column: Column) -> Column:
    """An Arrow function of an encoder and a batch, over the vocabulary, a file of known size."""
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        shared = SparkSession.getActiveSession().sparkContext.broadcast(Vocabulary(file.read()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = shared.value.encoder()
        for batch in batches:
            yield function(encoder, batch)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(column)


def _texts(batch: pa.Array) -> list[str]:
    return [text or "" for text in batch.to_pylist()]


def encode_column(text: Column, path: str | None = None) -> Column:
    """The ids of a text as packed bytes; a null text counts as empty, special tokens in a text are
    themselves."""

    def encode(encoder: Encoder, batch: pa.Array) -> pa.Array:
        return pa.array([b"".join([ids for ids, _ in parts]) for parts in encoder.encode(_texts(batch))], pa.binary())

    return _column(encode, path, "binary", text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The tokens of packed ids with blanks in between; null counts as no ids."""

    def decode(encoder: Encoder, batch: pa.Array) -> pa.Array:
        texts = encoder.texts
        rows = ([texts[i] for i in np.frombuffer(row or b"", "<u4").tolist()] for row in batch.to_pylist())
        return pa.array([b" ".join(row).decode() for row in rows], pa.string())

    return _column(decode, path, "string", ids)


def round_trip_column(text: Column, path: str | None = None) -> Column:
    """Struct of n_tokens, the digest of the ids and that of the text decoded from them."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(encoder: Encoder, batch: pa.Array) -> pa.Array:
        sizes, ids_hex, decoded_hex = [], [], []
        for parts in encoder.encode(_texts(batch)):
            size, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
            for ids, decoded in parts:
                if ids:
                    decoded_sha.update(b" " + decoded if size else decoded)
                    ids_sha.update(ids)
                    size += len(ids) // 4
            sizes.append(size)
            ids_hex.append(ids_sha.hexdigest())
            decoded_hex.append(decoded_sha.hexdigest())
        columns = [pa.array(sizes, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return _column(run, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", text)


def op12_trie_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", round_trip_column(named("text")).alias("r")).select("doc_id", "r.*")
