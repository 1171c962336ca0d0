"""Cleaning a corpus: from documents to encoded documents, one stage after the other.

Every stage takes the session, the documents its predecessor kept and the folder of the tables, and
returns documents with the same columns; the last one returns a line per document with its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import bpe, decontaminate, lines, minhash, toxicity
from lakeops.llm.common import stored, table

# Stages on word shingles link documents from this similarity on, in hundredths; op10 has a bound of its own.
NEAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half. The classifier learns from ``labels`` outside the
    held-out fold, on the documents at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model) < 0.5)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier, short ones included if they are equal. All
    documents stay, some without text."""
    found = lines.deduplicate_lines(docs, result_col="_lines", equal_chars=1)
    text = F.col("_lines")["text"]
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Those without words stay."""
    ids = minhash.near_duplicates(docs, percent=NEAR_PERCENT).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    dropped = stored(ids.where(~F.col("kept")).select("doc_id"), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is from the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, code points decoded."""
    return docs.select("doc_id", bpe.round_trip_column(F.col("text")).alias("r")).select("doc_id", "r.*")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", decontaminate_documents),
    ("byte_bpe", encode_documents),
]
# Neither a trained classifier nor an encoder can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
