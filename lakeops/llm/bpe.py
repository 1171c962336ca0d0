"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

**Encoding.** Merging by rank never crosses the boundary of two tokens that end up side by side, so
a row of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
*their* bytes. Every prefix of a piece therefore has one encoding, which extends the encoding of a
shorter prefix by one token. A nondeterministic transducer guesses the boundaries; its
determinisation holds, as one state, every boundary that may still be extended:

    (the last emitted token, the bytes since)

with the token that ends at each of these bytes; a step looks only at the boundaries from which a
token may go on. Tokens on which all boundaries agree are emitted at once,
so what is pending is bounded by the longest token. States and transitions are made when first
needed and kept in a table of bounded size; afterwards a byte costs one lookup.

**Decoding.** Ids are bytes; an incremental UTF-8 state machine gives out whole code points and
carries an unfinished one over to the next piece of input.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import named, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# What the tables of states, pairs and pieces may hold before they are emptied and begun anew.
MAX_STATES = 500_000
MAX_PAIRS = 800_000
MAX_PIECES = 300_000
MAX_CHUNKS = 900_000
MAX_PIECE_BYTES = 64
BYTES = [bytes((byte,)) for byte in range(256)]
# No token, packed.
NONE = b"\xff\xff\xff\xff"
# Code points of a text that are split and encoded at a time, and ids that are decoded at a time.
STEP = 1 << 16


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; a line is the token in base64 and its rank."""
    pairs = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pairs[int(rank)] = base64.b64decode(token)
    return [pairs.get(rank, b"") for rank in range(max(pairs) + 1)]


class Transducer:
    """Encodes single pieces of bytes; tables grow on demand and are bounded."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.size = list(map(len, tokens))
        self.packed = [struct.pack("<I", i) for i in range(len(tokens))]
        # By bytes: twice their token and two, or nothing without one; and one if a longer token begins with them.
        self.kinds = {t: 2 * i + 2 for t, i in self.rank.items()}
        for prefix in {t[:k] for t in self.rank for k in range(1, len(t))}:
            self.kinds[prefix] = self.kinds.get(prefix, 0) + 1
        self.parts: dict[int, tuple[int, int] | None] = {}
        # By the left token times the number of tokens, and the right one.
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state is known by the last emitted token (packed, or -1) and the bytes since. Its content also
        # has the token that ends at each of these bytes, and the boundaries from which a token may go on.
        self.states: dict[bytes, int] = {}
        self.content: list[tuple] = []
        # By state and byte: the next state and the tokens emitted, packed.
        self.moves: dict[int, tuple[int, bytes]] = {}
        # Rows of boundaries, each once.
        self.rows: dict[tuple, tuple] = {}
        self.start = self.state(NONE, (-1,), (0,))

    def state(self, key: bytes, ending: tuple, live: tuple) -> int:
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.content)
            self.content.append((key, ending, self.rows.setdefault(live, live)))
        return number

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; None if its own bytes merge otherwise.

        A single byte is the pair of itself and -1.
        """
        if token in self.parts:
            return self.parts[token]
        rank, data = self.rank, self.tokens[token]
        parts, result = [data[i : i + 1] for i in range(len(data))], None
        if len(parts) == 1:
            result = (token, -1)
        while len(parts) > 1:
            ranks = [rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 40:
                break
            if len(parts) == 2:
                result = (rank[parts[0]], rank[parts[1]])
            best = ranks.index(least)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        self.parts[token] = result
        return result

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side; -1 on the left is the begin of a piece.

        The merges are undone from the last one on. What faces each other at the boundary at any
        time must not merge before one of the two went into its own token; of equal ranks the left
        merge comes first.
        """
        pair = left * len(self.tokens) + right
        known = self.pairs.get(pair)
        if known is not None:
            return known
        tokens, rank = self.tokens, self.rank
        x, y, limit, known = left, right, 1 << 40, self.split(right) is not None
        while known and left >= 0:
            across = rank.get(tokens[x] + tokens[y])
            if across is not None and across < limit:
                known = False
                break
            x_made = x if len(tokens[x]) > 1 else -1
            y_made = y if len(tokens[y]) > 1 else -1
            if x_made < 0 and y_made < 0:
                break
            if x_made > y_made:
                limit, x = x, self.split(x)[1]
            else:
                limit, y = y + 1, self.split(y)[0]
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The next state and the tokens emitted on the way to it; made once, then looked up."""
        kinds, pairs, many = self.kinds, self.pairs, len(self.tokens)
        key, ending, live = self.content[state]
        key += BYTES[byte]
        data = key[4:]
        found, still = -1, []
        for at in live:
            kind = kinds.get(data[at:] if at else data)
            if kind is None:
                continue
            if kind & 1:
                still.append(at)
            if found < 0 and kind > 1:
                left, token = ending[at], (kind >> 1) - 1
                fits = pairs.get(left * many + token)
                if fits is None:
                    fits = self.fits(left, token)
                if fits:
                    found = token
        if found < 0:
            raise AssertionError("a prefix without an encoding")
        ending += (found,)
        emitted = b""
        if still and not still[0]:
            still.append(len(data))
        else:  # the oldest boundary is gone: emit what all others agree on
            size, root = self.size, len(data)
            for at in reversed(still):
                while at != root:
                    if at > root:
                        at -= size[ending[at]]
                    else:
                        root -= size[ending[root]]
            still.append(len(data))
            if root:
                emitted = self.path(ending, root)
                ending, still = ending[root:], [at - root for at in still]
                key = self.packed[ending[0]] + data[root:]
        move = self.moves[state << 8 | byte] = (self.state(key, ending, tuple(still)), emitted)
        return move

    def path(self, ending: tuple, at: int) -> bytes:
        """The tokens on the way to the boundary ``at``, packed."""
        out = b""
        while at > 0:
            token = ending[at]
            out = self.packed[token] + out
            at -= self.size[token]
        return out

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece, packed. A piece that is a token is that token."""
        token = self.rank.get(piece)
        if token is not None:
            return self.packed[token]
        if len(self.content) > MAX_STATES:
            self.reset()
        out: list[bytes] = []
        state, moves = self.start, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.content) > 2 * MAX_STATES:  # one endless piece: begin the tables anew
                    content = self.content[state]
                    self.reset()
                    state, moves = self.state(*content), self.moves
                move = self.step(state, byte)
            state, emitted = move
            if emitted:
                out.append(emitted)
        ending = self.content[state][1]
        out.append(self.path(ending, len(ending) - 1))
        return b"".join(out)


class Encoder:
    """Splits texts by the pattern and encodes each match; frequent pieces are remembered.

    A single blank between two other characters that are no white space always begins a match. So
    texts in which every blank is of this kind are cut there first, and what stands between two
    blanks is remembered as a whole.
    """

    # White space beside a blank, and white space that is rare enough to take the plain way at once.
    BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
    RARE_WHITE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, tokens: list[bytes], pattern: str):
        self.transducer = Transducer(tokens)
        self.pattern = regex.compile(pattern)
        self.cut_at_blanks = pattern == split_pattern()
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        packed = self.transducer.encode(data)
        if len(data) <= MAX_PIECE_BYTES:
            if len(self.known) >= MAX_PIECES:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def matches(self, text: str) -> bytes:
        """Ids of all matches of the pattern."""
        known, piece = self.known, self.piece
        if len(text) <= STEP:
            return b"".join([known.get(p) or piece(p) for p in self.pattern.findall(text)])
        out, part = [], []
        for match in self.pattern.finditer(text):
            p = match.group()
            part.append(known.get(p) or piece(p))
            if len(part) >= STEP:
                out.append(b"".join(part))
                part = []
        return b"".join([*out, *part])

    def chunk(self, chunk: str) -> bytes:
        # A blank and letters are one match.
        plain = chunk.isascii() and chunk.isalpha()
        packed = self.transducer.encode(b" " + chunk.encode()) if plain else self.matches(" " + chunk)
        if len(chunk) <= MAX_PIECE_BYTES:
            if len(self.after_blank) >= MAX_CHUNKS:
                self.after_blank.clear()
            self.after_blank[chunk] = packed
        return packed

    def only_single_blanks(self, text: str) -> bool:
        """Whether every blank stands between two characters that are no white space."""
        return not (
            text[:1] == " "
            or text[-1:] == " "
            or any(pair in text for pair in self.BESIDE)
            or self.RARE_WHITE.search(text)
        )

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cut_at_blanks or not self.only_single_blanks(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        known, chunk = self.after_blank, self.chunk
        return self.matches(first) + b"".join([known.get(c) or chunk(c) for c in rest])


class Utf8Stream:
    """Incremental UTF-8: bytes in, whole code points out; what is malformed becomes U+FFFD."""

    def __init__(self):
        self.rest = b""
        self.bad = 0

    # Bytes of a sequence by its lead byte; 0 stands for a byte that leads nothing.
    LENGTH = bytes([1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [0] * 11)

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        cut = len(data)
        if not last:
            # Walk back over at most three continuation bytes to the lead byte of the last sequence.
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 != 0x80:
                    if self.LENGTH[byte] > back:
                        cut -= back
                    break
        self.rest = data[cut:]
        try:
            return codecs.decode(data[:cut], "utf-8")
        except UnicodeDecodeError:
            text = data[:cut].decode("utf-8", "replace")
            self.bad += text.count("�")
            return text


class Vocabulary:
    """Tokens and pattern for all tasks. A worker that is used again keeps its tables."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.made = tokens, pattern, None

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "made": None}

    def encoder(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.tokens, self.pattern)
        return self.made


class Decoder:
    """Ids back to bytes and text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    def chunks(self, packed: bytes):
        """The bytes of the ids, ``STEP`` ids at a time."""
        ids = np.frombuffer(packed, dtype="<u4")
        tokens = self.tokens
        for i in range(0, len(ids), STEP):
            yield b"".join([tokens[t] for t in ids[i : i + STEP].tolist()])

    def text(self, packed: bytes) -> str:
        stream = Utf8Stream()
        out = [stream.feed(chunk) for chunk in self.chunks(packed)]
        out.append(stream.feed(b"", last=True))
        return "".join(out)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_column(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The ids of a text as packed bytes; a null text counts as empty."""
    shared = _shared(path, pattern)

    def encode(texts: "Iterator[pa.Array]") -> "Iterator[pa.Array]":  # noqa: F821
        encoder = shared.value.encoder()
        for batch in texts:
            yield pa.array([encoder.encode(t.as_py() or "") for t in batch], pa.binary())

    return _iterating(encode, "binary")(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of packed ids."""
    shared = _shared(path, None)

    def decode(packed: "Iterator[pa.Array]") -> "Iterator[pa.Array]":  # noqa: F821
        decoder = Decoder(shared.value.tokens)
        for batch in packed:
            yield pa.array([decoder.text(b.as_py() or b"") for b in batch], pa.string())

    return _iterating(decode, "string")(ids)


def round_trip_column(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Struct of a text encoded and decoded again: ids, n_tokens, their SHA-256 and that of the decoded bytes,
    the number of malformed places. The ids go on as bytes; a null text counts as empty."""
    shared = _shared(path, pattern)
    kind = pa.struct(
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chars", pa.int64())]
    )

    def run(texts: "Iterator[pa.Array]") -> "Iterator[pa.Array]":  # noqa: F821
        encoder, decoder = shared.value.encoder(), Decoder(shared.value.tokens)
        # The tables have no cycles, so nothing is looked for in them while they grow.
        gc.disable()
        try:
            for batch in texts:
                out = []
                for text in batch:
                    packed = encoder.encode(text.as_py() or "")
                    stream, digest, chars = Utf8Stream(), hashlib.sha256(), 0
                    for chunk in decoder.chunks(packed):
                        digest.update(chunk)
                        chars += len(stream.feed(chunk))
                    chars += len(stream.feed(b"", last=True))
                    out.append(
                        {"n_tokens": len(packed) // 4, "ids_sha256": hashlib.sha256(packed).hexdigest(),
                         "decoded_sha256": digest.hexdigest(), "n_chars": chars}
                    )
                yield pa.array(out, kind)
        finally:
            gc.enable()

    return _iterating(run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long")(text)


def _shared(path: str | None, pattern: str | None):
    """The vocabulary, a file of known size, broadcast."""
    vocabulary = Vocabulary(read_ranks(path or vocabulary_path()), pattern or split_pattern())
    return SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)


def _iterating(function, kind: str):
    from collections.abc import Iterator

    function.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    if "texts" not in function.__code__.co_varnames:
        function.__annotations__ = {"packed": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(function, kind)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("r")
    return docs.select("doc_id", round_trip_column(named("text")).alias("r")).select(
        "doc_id",
        r["n_tokens"].alias("n_tokens"),
        r["ids_sha256"].alias("ids_sha256"),
        r["decoded_sha256"].alias("decoded_sha256"),
        r["n_chars"].alias("n_chars"),
    )
