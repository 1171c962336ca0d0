"""The registered queries beside their SQL, and the pipeline stage by stage."""

import random

import pytest
from check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lakeops.llm import decontaminate, lines, minhash
from lakeops.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Query:
    def __init__(self, build, sql):
        self.build, self.sql = build, sql

    def __call__(self, spark, sf_dir):
        return self.build(spark, sf_dir)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_beside_its_sql(spark, name):
    assert compare(spark, connect(SF), Query(*QUERIES[name]), SF) is None


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in entry.queries()) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").limit(2))
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name, stage in list(stages.items())[:-1]:
        seen[name] = stage(spark, docs, SF).cache()
        assert seen[name].columns == docs.columns, name
        assert seen[name].count() <= docs.count()
    assert seen["line_dedup"].count() == docs.count()
    again = lines.deduplicate_lines(seen["line_dedup"], result_col="r").agg(F.sum("r.n_dropped")).first()[0]
    assert again == 0
    assert minhash.near_duplicates(seen["near_dedup"]).where("not kept").count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    scanned = decontaminate.scan_documents(seen["decontamination"], items)
    assert scanned.where(decontaminate.contaminated(F.col("contamination"))).count() == 0
    last = stages["byte_bpe"](spark, seen["decontamination"], SF)
    assert last.count() == seen["decontamination"].count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) <= 200 and all(r.n_tokens >= 0 for r in rows)


def test_near_dedup_stage_links_from_080(spark):
    rng = random.Random(5)
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    rows, similar = [], []
    for k in range(12):  # pairs on both sides of 0.80
        base = [f"w{k}x{rng.randrange(10**6)}" for _ in range(200)]
        other = base[:]
        for at in rng.sample(range(200), 3 + k % 3):
            other[at] = f"new{k}x{at}"
        a, b = shingles(base), shingles(other)
        similar.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(other), "en", "s", 1)]
    assert any(0.80 <= x < 0.85 for x in similar) and any(x < 0.80 for x in similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.deduplicate_documents(spark, docs, SF).collect()}
    assert kept == {2 * k for k in range(12)} | {2 * k + 1 for k, x in enumerate(similar) if x < 0.80}


def test_line_stage_drops_short_repeats(spark):
    rows = [(1, "ok\n\nRead more\n ok"), (2, "Read more\nnew\n\nRead mare"), (3, None), (None, "ok\nok"), (4, "ok")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.deduplicate_lines(spark, docs, SF).collect()}
    assert got == {1: "ok\n\nRead more", 2: "new\n\nRead mare", 3: None, None: "ok\nok", 4: ""}
