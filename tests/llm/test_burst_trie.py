"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from lakeops.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, `a.b` string"


def brute(rows):
    """{(depth, conv_id): the other columns} for (conv, turn, role, text) rows."""

    def key(role, text):
        role, text = role or "", text or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), len(text)

    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, *key(role, text)))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))  # the remainder has the sign of the id
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    out = {}
    for prefix, convs_of in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = sorted(c for c in convs_of if len(rebuilt[c]) == len(prefix))
        out[len(prefix), min(convs_of)] = (
            min(members[prefix[:-1]]) if prefix else None,
            len(convs_of),
            children[prefix],
            sum(children[p] == 0 for p in below),
            sum((len(members[p]) - 1) * p[-1][1] for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def check(spark, rows, partitions=3):
    data = [(*r, 7, "k") for r in rows]
    found = burst_trie.conversation_trie(spark.createDataFrame(data, SCHEMA).repartition(partitions)).collect()
    got = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(found) == len(got)
    assert got == brute(rows)


@pytest.fixture
def small(monkeypatch):
    """Segments of three turns and containers of two strings: every part of the work takes place."""
    monkeypatch.setattr(burst_trie, "SEGMENT", 3)
    monkeypatch.setattr(burst_trie, "CAPACITY", 2)


def test_odd_rows(spark):
    check(spark, [
        (None, 1, "user", "lost"), (0, 1, "user", "hi"), (0, 2, None, "yo"), (0, None, "user", "first"), (0, 2, "bot", None),
        (5, 1, "user", "hi"), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (-5, 3, "x", "neg"), (-105, 3, "x", "neg"), (-100, 1, "x", "base"),
        (7, 0, "a", "b"), (207, 0, "a", "b"), (200, 0, "é漢", "😀 text"), (299, 0, None, None), (299, 1, "", ""), (2**62, 1, "user", "hi"),
    ])


def test_no_rows(spark):
    assert burst_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert burst_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "k")], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, small, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(45):
        conv = rng.randrange(-250, 450)
        for turn in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 13])):
            rows.append((conv, turn, rng.choice(["u", "b", None]) if rng.random() < 0.2 else "u", rng.choice(["a", "bb", "ccc"])))
    check(spark, rows)


def test_long_copies_and_one_that_goes_on(spark, small):
    """Copies of six turns, exactly two segments; some go on, one of them for long; a smaller id ends
    at the border of a segment."""
    rows = []
    for conv in [*range(1000, 1040), 900]:
        rows += [(conv, t, "u", f"turn {t}") for t in range(6)]
    for conv in (1003, 1010, 1017):
        rows += [(conv, t, "u", f"more {t} {conv % 2}") for t in range(6, 9)]
    rows += [(1010, t, "u", "deep") for t in range(9, 40)]
    rows += [(901, t, "u", f"turn {t}") for t in range(3)]
    check(spark, rows)


def test_hot_turn_at_real_sizes(spark):
    """More strings below one turn than a container holds, and more conversations than a block."""
    rng = random.Random(9)
    rows = []
    for conv in range(0, 30000, 100):
        rows += [(conv, 0, "system", "hot"), *[(conv, t, "u", rng.choice("abcdef") * t) for t in range(1, rng.randrange(1, 6))]]
    check(spark, rows, 5)
