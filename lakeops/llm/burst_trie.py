"""The prefix trie of conversations, grown as burst tries.

A turn becomes an id of fixed size (a digest of role and text, and the text's length), and a
conversation a string of ids. Equal strings are one row. A *container* holds the strings below one
node of the trie, its *head*, without the part that leads there. A container with too many strings
bursts: what all its strings share becomes a chain of nodes, and the strings move into containers
by their next turn id. This is repeated for the containers that are still too large, so a turn that
begins a third of all conversations costs a few rounds and no task of its own. The remaining
containers are dealt out, sorted and swept into nodes, each in one pass.

Strings are cut into segments of ``SEGMENT`` turns, so that no conversation has to fit a row. A segment
is a string below a head that is known beforehand: the digest of all turns before it. The sums of
the containers of later segments are then handed up along the conversations that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeops.llm.common import named, stored, table
from lakeops.operators.numbering import number_rows

# Strings that a container may hold before it bursts.
CAPACITY = 64
# Turns of a segment, and bytes of a turn id: 16 of a digest, 4 of a length.
SEGMENT = 128
WIDTH = 20
# A conversation borrows up to five turns from the one whose id ends its hundred.
HUNDRED, BORROWED = 100, 6
# Containers that burst in a round are broadcast (40 bytes each) up to this number.
MAX_BROADCAST = 20_000
NOTHING = hashlib.sha256().hexdigest()


# ------------------------------------------------------------------ conversations as strings


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the digest of role and text, then the text's code points."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0")))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``key`` and ``size`` (turns of the conversation) of every turn of the
    rebuilt conversations, and a line without key at the end of each.

    Turns are numbered over sorted ranges, so a conversation of any length spreads over tasks. Turns
    of the same number are taken in the order of their ids.
    """
    ids = turns.select(
        named("conv_id").cast("long").alias("conv"),
        named("turn").cast("long").alias("turn"),
        turn_id(named("role"), named("text")).alias("key"),
    ).where("conv IS NOT NULL")
    ids = ids.withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("copy")]
    numbered = number_rows(ids, order, "number").select("conv", "key", "number")
    sizes = stored(numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED
    plan = (
        sizes.withColumn("head", head)
        .withColumn("base", F.col("conv") - F.col("conv") % HUNDRED)
        .join(bases, "base", "left")
        .withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
        .withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    )
    plan = stored(plan.select("conv", "base", "first", "head", "taken", "size"), "plan")
    placed = numbered.join(plan, "conv").withColumn("at", F.col("number") - F.col("first"))
    own = placed.where("at >= head").select("conv", (F.col("at") - F.col("head") + F.col("taken")).alias("place"), "key", "size")
    lent = placed.where((F.col("conv") % HUNDRED == 0) & (F.col("at") < BORROWED)).select(F.col("conv").alias("base"), "at", "key")
    lent = plan.join(lent, "base").where("at < head").select("conv", F.col("at").alias("place"), "key", "size")
    ends = plan.select("conv", F.col("size").alias("place"), F.lit(None).cast("binary").alias("key"), "size")
    return own.unionAll(lent).unionAll(ends)


def segments(turns: DataFrame) -> DataFrame:
    """A line per conversation and segment: its ``ids`` and ``head``, the digest of what comes before.
    A conversation whose turns fill its segments has an empty one at the end."""
    rows = (
        turns.groupBy("conv", F.expr(f"CAST(place DIV {SEGMENT} AS INT)").alias("seg"))
        .agg(
            F.expr("listagg(key) WITHIN GROUP (ORDER BY place)").alias("ids"),
            F.max("size").alias("size"),
        )
        .withColumn("ids", F.coalesce("ids", F.lit(b"")))
    )
    rows = stored(rows, "segments")
    before = W.partitionBy("conv").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    words = [F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(k), "seg", "ids")).over(before)), 16, "0") for k in (1, 2)]
    head = F.unhex(F.concat(*words, F.lpad(F.hex("seg"), 8, "0")))
    long = rows.where(F.col("size") >= SEGMENT).withColumn("head", F.coalesce(head, F.lit(b"")))
    short = rows.where(F.col("size") < SEGMENT).withColumn("head", F.lit(b""))
    return long.unionByName(short)


STRINGS = (
    "seg int, head binary, ids binary, n long, conv long, more boolean, kids long, leaves long, saved long, ends string"
)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal strings, in order, to one line each; the digest of the ids runs through them."""
    names = [field.split()[0] for field in STRINGS.split(", ")]
    row, key, digest, any_ids = None, None, None, False

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
        fields = [pa.field(*(f.split()[0], kinds[f.split()[1]])) for f in STRINGS.split(", ")]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    for batch in batches:
        out = []
        for line in batch.to_pylist():
            if line["sid"] != key:
                if row is not None:
                    out.append({**row, "ends": digest.hexdigest()})
                key, digest, any_ids = line["sid"], hashlib.sha256(), False
                row = {name: line[name] for name in names[:-1]}
            else:
                for name in ("n", "kids", "leaves", "saved"):
                    row[name] += line[name]
                row["conv"] = min(row["conv"], line["conv"])
                row["more"] = row["more"] or line["more"]
            if line["convs"]:
                digest.update((("," if any_ids else "") + line["convs"]).encode())
                any_ids = True
        if out:
            yield batch_of(out)
    if row is not None:
        yield batch_of([{**row, "ends": digest.hexdigest()}])


def strings(rows: DataFrame) -> DataFrame:
    """Equal strings below one head as one line: ``n`` conversations, ``conv`` the smallest, ``more``
    if one of them goes on after a full segment, ``ends`` the digest of those that end here.

    The conversations that end here are listed in blocks of 4096 consecutive ids, each sorted; the
    blocks of a string are then taken in order, one after the other.
    """
    depth = F.col("seg").cast("long") * SEGMENT + (F.length("ids") / WIDTH).cast("long")
    sid = F.unhex(F.md5(F.concat(F.unhex(F.md5("head")), "ids")))
    listed = F.sort_array(F.collect_list(F.when(F.col("size") == depth, F.col("conv"))))
    blocks = (
        rows.groupBy(sid.alias("sid"), "seg", "head", "ids", F.shiftright("conv", 12).alias("block"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("conv").alias("conv"),
            F.max(F.col("size") > (F.col("seg").cast("long") + 1) * SEGMENT).alias("more"),
            *[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")],
            F.array_join(F.transform(listed, lambda c: c.cast("string")), ",").alias("convs"),
        )
        .repartition("sid")
        .sortWithinPartitions("sid", "block")
    )
    return blocks.mapInArrow(_collapse, STRINGS)


# ------------------------------------------------------------------ containers to nodes

NODES = (
    "conv long, depth long, up long, n long, kids long, leaves long, saved long, ends string, "
    "top boolean, seg int, path array<binary>"
)


def sweep_container(rows: list[dict]) -> list[dict]:
    """The nodes of one container from its strings in sorted order, the head first.

    Strings are distinct, so a string that begins another one comes before it and every node is
    made by the first string through it. Nodes are numbered as they are made; sums go up from the
    last one to the first, after which all parents know their smallest conversation.
    """
    first = rows[0]
    nodes = [[None, first["at"], -1, 0, 0, 0, 0, NOTHING, False, first["last"]]]
    path, before = [0], b""
    for row in rows:
        ids = row["ids"]
        shared = 0
        while shared < min(len(ids), len(before)) and ids[shared : shared + WIDTH] == before[shared : shared + WIDTH]:
            shared += WIDTH
        del path[shared // WIDTH + 1 :]
        for at in range(shared, len(ids), WIDTH):
            chars = int.from_bytes(ids[at + 16 : at + WIDTH], "big")
            nodes.append([None, first["at"] + at // WIDTH + 1, path[-1], 0, 0, 0, 0, NOTHING, False, chars])
            path.append(len(nodes) - 1)
        end = nodes[path[-1]]
        end[0] = row["conv"] if end[0] is None else min(end[0], row["conv"])
        for k, name in ((3, "n"), (4, "kids"), (5, "leaves"), (6, "saved")):
            end[k] += row[name]
        end[7], end[8] = row["ends"], row["more"]
        before = ids
    for node in reversed(nodes):
        conv, _, parent, n, kids, leaves, saved, _, more, chars = node
        node[5] = leaves = leaves + (kids == 0 and not more)
        node[6] = saved = saved + (n - 1) * chars
        if parent >= 0:
            above = nodes[parent]
            above[0] = conv if above[0] is None else min(above[0], conv)
            above[3] += n
            above[4] += 1
            above[5] += leaves
            above[6] += saved
    return [
        {"conv": conv, "depth": depth, "up": first["up"] if k == 0 else nodes[parent][0], "n": n, "kids": kids,
         "leaves": leaves, "saved": saved, "ends": ends, "top": k == 0 and first["top"], "seg": first["seg"],
         "path": first["path"] if k == 0 else None}
        for k, (conv, depth, parent, n, kids, leaves, saved, ends, _, _) in enumerate(nodes)
    ]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers that follow each other, sorted; at most ``CAPACITY`` lines are held."""
    longs = ("conv", "depth", "up", "n", "kids", "leaves", "saved")
    schema = pa.schema(
        [(name, pa.int64()) for name in longs]
        + [("ends", pa.string()), ("top", pa.bool_()), ("seg", pa.int32()), ("path", pa.list_(pa.binary()))]
    )
    held: list[dict] = []
    for batch in batches:
        out = []
        for line in batch.to_pylist():
            if held and held[0]["head"] != line["head"]:
                out += sweep_container(held)
                held = []
            held.append(line)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist(sweep_container(held), schema=schema)


def _chars(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 17, 4)), 16, 10).cast("long")


def _burst(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round: containers that burst (a line each), what their strings became, and the strings of
    all others. None if no container is too large."""
    same = ("at", "up", "last", "path", "top", "seg")
    lengths = F.least(F.length("low"), F.length("high")) / WIDTH
    steps = F.sequence(F.lit(1), lengths.cast("int"))
    agree = F.filter(
        F.when(lengths > 0, steps).otherwise(F.array().cast("array<int>")),
        lambda k: F.col("low").substr(F.lit(1), k * WIDTH) == F.col("high").substr(F.lit(1), k * WIDTH),
    )
    # What the least and the greatest string share, all strings between them share.
    big = (
        live.groupBy("head")
        .agg(
            F.count(F.lit(1)).alias("strings"),
            F.min("ids").alias("low"),
            F.max("ids").alias("high"),
            F.sum("n").alias("n"),
            F.min("conv").alias("conv"),
            *[F.first(c).alias(c) for c in same],
        )
        .where(F.col("strings") > CAPACITY)
        .withColumn("shared", F.size(agree))
        .withColumn("chain", F.col("low").substr(F.lit(1), F.col("shared") * WIDTH))
        .drop("low", "high", "strings")
    )
    big = stored(big, "burst")
    n_big = big.count()
    if not n_big:
        return None
    facts = big.select("head", "shared", F.col("conv").alias("least"))
    facts = F.broadcast(facts) if n_big <= MAX_BROADCAST else facts
    rest = live.join(facts.select("head"), "head", "left_anti")
    skip = F.col("shared") * WIDTH
    follows = F.col("ids").substr(skip + 1, F.lit(WIDTH))
    moved = live.join(facts, "head").select(
        F.col("head").alias("old"),
        F.unhex(F.md5(F.concat(F.unhex(F.md5("head")), F.col("ids").substr(F.lit(1), skip + WIDTH)))).alias("head"),
        (F.col("at") + F.col("shared") + 1).alias("at"),
        F.col("least").alias("up"),
        F.when(F.length(follows) > 0, _chars(follows)).alias("last"),
        F.concat("path", F.array("head")).alias("path"),
        F.lit(False).alias("top"),
        F.col("ids").substr(skip + WIDTH + 1, F.length("ids")).alias("ids"),
        (F.length(follows) > 0).alias("goes_on"),
        "seg", "n", "conv", "more", "kids", "leaves", "saved", "ends",
    )
    return big, stored(moved, "moved"), rest


def _chains(big: DataFrame, moved: DataFrame, swept: DataFrame) -> DataFrame:
    """The nodes of burst containers: the head and the chain below it."""
    chars = F.transform(
        F.sequence(F.lit(0), F.col("shared")),
        lambda k: F.when(k == 0, F.col("last")).otherwise(_chars(F.col("chain").substr((k - 1) * WIDTH + 1, F.lit(WIDTH)))),
    )
    others = F.col("n") - 1

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)

    own = big.select("path", F.lit(0).cast("long").alias("leaves"), (others * total(chars)).alias("saved"))
    parts = swept.where("path IS NOT NULL").select("path", "leaves", "saved").unionAll(own)
    below = (
        parts.select(F.explode("path").alias("head"), "leaves", "saved")
        .groupBy("head")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    children = moved.where("goes_on").select(F.col("old").alias("head"), F.col("head").alias("child")).distinct()
    children = children.groupBy("head").agg(F.count(F.lit(1)).alias("kids"))
    ended = moved.where("NOT goes_on").select(F.col("old").alias("head"), "ends")
    found = big.withColumn("chars", chars).join(below, "head").join(children, "head").join(ended, "head", "left")
    return found.select("*", F.posexplode("chars").alias("k", "char")).select(
        "conv",
        (F.col("at") + F.col("k")).alias("depth"),
        F.when(F.col("k") == 0, F.col("up")).otherwise(F.col("conv")).alias("up"),
        "n",
        F.when(F.col("k") == F.col("shared"), F.col("kids")).otherwise(F.lit(1)).alias("kids"),
        "leaves",
        (F.col("saved") + others * total(F.slice("chars", F.col("k") + 1, F.size("chars")))).alias("saved"),
        F.when(F.col("k") == F.col("shared"), F.coalesce("ends", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends"),
        ((F.col("k") == 0) & F.col("top")).alias("top"),
        "seg",
    )


def grow(rows: DataFrame) -> DataFrame:
    """All nodes of the tries of the given segments (see ``strings``), with ``top`` for the heads of
    segments."""
    live = stored(
        strings(rows).select(
            "*",
            (F.col("seg").cast("long") * SEGMENT).alias("at"),
            F.lit(None).cast("long").alias("up"),
            F.lit(0).cast("long").alias("last"),
            F.array().cast("array<binary>").alias("path"),
            F.lit(True).alias("top"),
        ),
        "strings",
    )
    kept, rounds = [], []
    while True:
        burst = _burst(live)
        if burst is None:
            kept.append(live)
            break
        big, moved, rest = burst
        rounds.append((big, moved))
        kept.append(rest)
        live = moved.where("goes_on").drop("old", "goes_on")
    containers = reduce(DataFrame.unionByName, kept)
    swept = containers.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_sweep, NODES)
    swept = stored(swept, "swept")
    nodes = swept.drop("path")
    if rounds:
        big = reduce(DataFrame.unionByName, [b for b, _ in rounds])
        moved = reduce(DataFrame.unionByName, [m.select("old", "head", "goes_on", "ends") for _, m in rounds])
        nodes = nodes.unionByName(_chains(big, moved, swept))
    return nodes


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (columns conv_id, turn, role, text; others
    are not read).

    Null roles and texts are empty, null turns come first, turns of the same number are taken in the
    order of their ids; rows without a conversation belong to none. Without rows there is no node.
    Columns as in ``op13_conversation_trie``.
    """
    rows = segments(rebuilt_turns(turns))
    nothing = {c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")}
    plain = rows.withColumns(nothing)
    if not rows.where(F.col("size") > SEGMENT).isEmpty():
        # Sums below the heads of later segments, each carried by its smallest conversation, which
        # hands them up through all its earlier segments.
        tops = grow(plain.where("seg > 0")).where("top").select(
            "conv", (F.col("seg") - 1).alias("seg"), "kids",
            F.when(F.col("kids") > 0, F.col("leaves")).otherwise(0).alias("leaves"), "saved",
        )
        long = rows.where(F.col("size") >= SEGMENT).join(stored(tops, "tops"), ["conv", "seg"], "left").fillna(0, list(nothing))
        later = W.partitionBy("conv").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, 0)
        long = long.withColumns({c: F.sum(c).over(later) for c in ("leaves", "saved")})
        plain = plain.where(F.col("size") < SEGMENT).unionByName(long)
    nodes = grow(plain).where(~(F.col("top") & (F.col("seg") > 0)))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


# One step of a CRC over eight bits, folded over the digits of an id.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, w: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"
)
OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(r) || ':' || r || x) AS s FROM t),
o AS (SELECT c, list(struct_pack(s, chars := length(x)) ORDER BY turn NULLS FIRST, s) AS turns FROM k GROUP BY c),
h AS (SELECT *, {CRC32.format("c")} % 6 AS h FROM o),
rebuilt AS (SELECT h.c, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
            FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
p AS (SELECT c, d, sha256(array_to_string(list_transform(turns[1:d], lambda e: e.s), ',')) AS node,
             CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda e: e.s), ',')) END AS above,
             CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars, d = len(turns) AS ends
      FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
n AS (SELECT d, node, min(above) AS above, min(c) AS c, count(*) AS n, min(chars) AS chars,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends
      FROM p GROUP BY d, node),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, node)),
sums AS (SELECT p.d, p.node, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.chars) AS saved
         FROM f JOIN p ON p.c = f.c AND p.d <= f.d GROUP BY p.d, p.node)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN sums USING (d, node) LEFT JOIN n u ON u.node = f.above AND u.d = f.d - 1
"""
