"""Exact deduplication, line deduplication and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lakeops.llm import exact_index, lines, suffixes

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "é" * 70_000)]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(spark, make):
    rows = [*EDGES, (9, "a b"), (8, "ab"), (7, "a  b"), (6, "a b"), *[(100 + i, "hot text") for i in range(300)]]
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_index.exact_dedup(make(rows)).collect())
    want = []
    for i, t in rows:
        same = sorted((-len(u or ""), k is None, k or -1) for k, u in rows if bare(u) == bare(t))
        kept = (i or -1) == same[0][2] and len(t or "") == -same[0][0]
        want.append((i or -1, same[0][2], len(same), kept, hashlib.sha256(bare(t).encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_index.exact_dedup(make([])).count() == 0


def test_index_takes_new_batches(spark, make, tmp_path):
    index = exact_index.DigestIndex.create(spark, str(tmp_path / "index"), 4)
    index.add(make([(1, "a"), (2, "b")]))
    index.add(make([(3, "a "), (4, "c"), (5, "c  c")]))
    assert sorted(r.keep_id for r in index.entries().collect()) == [1, 2, 4, 5]
    assert {r.doc_id: r.keep_id for r in index.label(make([(3, "a ")])).collect()} == {3: 1}
    plan = index.entries().select("digest").join(index.entries().hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    index.close()
    again = exact_index.DigestIndex.open(spark, str(tmp_path / "index"), 4)
    again.add(make([(6, "b"), (7, "d")]))
    assert sorted(r.keep_id for r in again.entries().collect()) == [1, 2, 4, 5, 7]
    again.close()


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute_lines(rows, least):
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        stay = []
        for no, raw in enumerate(t.split("\n")):
            line = raw.strip(lines.WHITE)
            earlier = i is not None and len(line) >= least and any(
                near(line, other.strip(lines.WHITE))
                for k, u in rows
                if k is not None and u is not None and k <= i
                for m, other in enumerate(u.split("\n"))
                if (k, m) < (i, no) and len(other.strip(lines.WHITE)) >= least
            )
            if not earlier:
                stay.append(raw)
        out.append((i, "\n".join(stay), len(t.split("\n")) - len(stay)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(make, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([12, 13, 30, 60, 200]))) for _ in range(12)]

    def edited(line):
        at, kind = rng.randrange(len(line)), rng.randrange(5)
        if kind == 0:
            return line[:at] + line[at + 1 :]
        if kind == 1:
            return line[:at] + "z" + line[at:]
        if kind == 2:
            return line[:at] + "z" + line[at + 1 :]
        return line if kind == 3 else edited(edited(line))

    rows = [(i, "\n".join(f" {edited(rng.choice(base))}" for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    rows += [(None, base[0]), (41, None), (42, ""), (43, "short\nshort\n"), (44, "\n".join(["q" * 40] * 70))]
    got = lines.deduplicate_lines(make(rows), min_chars=10, result_col="n_words").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.n_words.text, r.n_words.n_dropped) for r in got), key=key) == sorted(brute_lines(rows, 10), key=key)


def test_lines_of_nothing(make):
    assert lines.deduplicate_lines(make([]), result_col="r").count() == 0


def brute_passages(rows):
    out = []
    for i, t in rows:
        text = (t or "").encode()
        hit = np.zeros(len(text), bool)
        if i is not None:
            others = [(u or "").encode() for k, u in rows if k is not None and k < i]
            for p in range(len(text) - 49):
                if any(text[p : p + 50] in o for o in others):
                    hit[p : p + 50] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((i or -1, len(text), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(make, seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    shared = [letters(n) for n in (49, 50, 51, 80, 200)] + ["a" * 120]
    rows = [(i, "".join(letters(rng.randrange(0, 60)) + rng.choice(shared) for _ in range(rng.randrange(0, 4)))) for i in rng.sample(range(500), 60)]
    rows += [(1000, rows[0][1]), (1001, rows[1][1]), (None, shared[4]), (1002, None), (1003, ""), (1004, shared[4]), (1004, shared[4] + "x")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(make(rows)).collect())
    assert got == brute_passages(rows)


def test_passages_of_nothing(make):
    assert suffixes.remove_repeats(make([])).count() == 0


def test_multikey_order_sorts_and_groups():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 3, (500, 7)).astype(np.uint64)
    keys[100:200] = keys[0]
    order, group = suffixes.multikey_order(keys)
    rows = [tuple(r) for r in keys[order].tolist()]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(group, group[1:])] == [a == b for a, b in zip(rows, rows[1:])]


def test_passages_longer_than_a_segment(monkeypatch, make):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(900))
    rows = [(1, text), (2, "zz" + text[100:700] + "y"), (3, text[650:] + text[:90])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(make(rows)).collect())
    assert got == brute_passages(rows)


def test_window_keys_order_like_the_bytes():
    rng = random.Random(6)
    runs = [bytes(rng.randrange(256) for _ in range(49 + n)) for n in (1, 5, 31)]
    keys, run, place = suffixes.window_keys(runs, np.array([1, 5, 31]))
    windows = [runs[r][p : p + 50] for r, p in zip(run, place)]
    assert [w[k : k + 8].ljust(8, b"\0")[: min(8, 50 - k)] for w in windows for k in range(0, 50, 8)] == [
        int(v).to_bytes(8, "big")[-min(8, 50 - k) :] for row in keys for k, v in zip(range(0, 50, 8), row)
    ]


def test_windows_across_ranges_go_in_few_lines():
    """Runs of one lead in many ranges: a line per bucket, not one per window, and marks as by hand."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(20)]
    runs = [{"lead": b"x", "doc_id": i, "at": 7, "mask": 1 if i == 3 else 0, "windows": 31, "run": texts[i % 20]} for i in range(200)]
    batches = pa.RecordBatch.from_pylist(runs, suffixes.RUN_SCHEMA)
    packed = pa.Table.from_batches(suffixes._pack(4)(iter([batches])))
    assert packed.num_rows <= 4 and sum(map(len, packed["windows"].to_pylist())) == 50 * (200 * 31 - 1)
    found = [r for k in range(4) for r in suffixes._across(packed.filter(pc.equal(packed["bucket"], k))).to_pylist()]
    masks = {}
    for r in found:
        masks[r["doc_id"], r["at"]] = masks.get((r["doc_id"], r["at"]), 0) | r["mask"]
    # The first window of document 3 is not among the rows: document 23 is the first to have it.
    assert masks == {(i, 7): (1 << 31) - (2 if i == 23 else 1) for i in range(20, 200)}
