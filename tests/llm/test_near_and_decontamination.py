"""Near-duplicates, components and benchmark decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakeops.llm import decontaminate, minhash
from lakeops.llm.components import components


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(200, 240)]
    want = brute_components(range(300), links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    of = brute_components(sets, links)
    return {i: (len(s), of[i], of[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(make, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(minhash, "BLOCK", 5)  # several blocks in a band
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta Theta ÄÖ ß".split()) + str(rng.randrange(300))
    bases = [[word() for _ in range(n)] for n in (60, 100, 200, 30)]
    rows = []
    for i in rng.sample(range(1000), 130):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words).upper() if rng.random() < 0.2 else "\t".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "b a"), (2006, "x " * 30_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_of_odd_rows(make):
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(make(rows)).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (1, 1, True)]
    assert minhash.near_duplicates(make([])).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        both, own = int(1000 * share), int(1000 * (1 - share) / 2)
        values = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        a, b = minhash.registers(values[: both + own]), minhash.registers(np.delete(values, np.s_[both : both + own]))
        got = minhash.estimate(np.array([(a == b).sum()]), np.array([both + own]), np.array([both + own]))[0]
        assert abs(got - share) < 0.15
    a, b = (minhash.registers(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert abs(minhash.estimate(np.array([(a == b).sum()]), np.array([500]), np.array([500]))[0]) < 0.05


def brute_decontamination(rows, items):
    words = lambda t: decontaminate.words_of((t or "").encode())
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k, text in items:
            v = words(text)
            size = min(13, len(v))
            windows = {tuple(v[p : p + size]) for p in range(len(v) - size + 1)} if size and k is not None else ()
            for p in range(len(w) - size + 1):
                if size and tuple(w[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    found.add(str(k))
        out.append((i or -1, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_against_brute_force(spark, make, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice("aa bb cc Dé ee2 ff".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 13, 14, 40])))) for k in range(3, 25)]
    items = [(k, t) for k, t in items if len(t.split()) > 4] + [(30, None), (31, " ,."), (None, "aa bb"), (32, items[5][1])]
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(rng.randrange(60)))
        rows.append((i, text + "; " + (rng.choice(items)[1] or "") if i % 3 else text))
    rows += [(None, items[0][1]), (50, None), (51, ""), (52, "aa " * 20_000), (0, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan_documents(make(rows), bench, result_col="kept", block_bytes=block_bytes).collect()
    assert sorted((r.doc_id or -1, r.kept.n_words, r.kept.n_hit, ",".join(r.kept["items"])) for r in got) == brute_decontamination(rows, items)
    if block_bytes > 1000:
        empty = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.scan_documents(make(rows), empty).where("contamination.n_hit > 0").count() == 0
        assert decontaminate.scan_documents(make([]), bench).count() == 0


def test_spans_and_documents_go(spark, make):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    rows = [(1, f"Before, {item.upper()}! After."), (2, "nothing of it"), (3, "w " * 400 + item), (4, None)]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(make(rows), bench, "spans").collect()}
    assert spans == {1: "Before, ! After.", 2: "nothing of it", 3: "w " * 400, 4: None}
    kept = decontaminate.decontaminate(make(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == make(rows).columns
    with pytest.raises(ValueError):
        decontaminate.decontaminate(make(rows), bench, "words")


def test_near_duplicates_of_ids_that_repeat(make):
    """All texts of an id belong to one document: a near copy of any of them is linked with it."""
    rng = random.Random(11)

    def text():
        return " ".join(f"w{rng.randrange(10_000)}" for _ in range(200))

    def near(t):
        return t + " more"

    one, two, three, four = text(), text(), text(), text()
    rows = [
        (1, one), (1, two), (1, two), (3, near(two)), (4, near(one)),  # the least id of both sets
        (7, three), (8, four), (9, near(three)), (9, four),  # an id that is in the sets of others
        (20, text()), (21, text()), (21, None), (22, ""),
    ]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (20, 20), (21, 21), (22, 22)}


@pytest.mark.parametrize("halves", [False, True])
def test_a_block_gives_out_fewer_links_than_it_has_members(halves):
    """Sets of one band that almost link are no rows, nor are the links that join nothing new."""
    core, out = [f"c{k}" for k in range(400)], []
    word = lambda k, n: [f"{k}w{i}" for i in range(n)]
    # 40 sets of 392 shingles in common out of 548 of two; then 30 that link with each other.
    texts = [" ".join(core + word(k, 78)) for k in range(40)] + [" ".join(core + word(k, 10)) for k in range(40, 70)]
    hashes = minhash.WordHashes()
    sets = [minhash.shingles(t.encode(), hashes) for t in texts]
    registers = [minhash.registers(s) for s in sets]
    for band in range(minhash.BANDS):
        at = slice(minhash.ROWS * band, minhash.ROWS * (band + 1))
        keys = {}
        for k, r in enumerate(registers):
            keys.setdefault(r[at].tobytes(), []).append(k)
        for key, (_, ks) in enumerate(sorted(keys.items())):
            rows = [
                {"key": key, "band": band, "i": 0, "j": int(halves), "rep": k, "root": k, "n": len(sets[k]),
                 "side": k % 2 if halves else 0, "registers": registers[k].tobytes(), "text": texts[k]}
                for k in ks
            ]
            found = [p for b in minhash._compare_blocks(85)([pa.RecordBatch.from_pylist(rows)]) for p in zip(*b.to_pydict().values())]
            assert len(found) < len(ks)
            out += found
    links = {(a, b) for a in range(70) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert links and set(out) <= links and brute_components(range(70), out) == brute_components(range(70), links)
