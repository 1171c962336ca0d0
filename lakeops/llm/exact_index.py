"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

Only DataFrame functions run here. The index is a Parquet table with a line per distinct
normalised text: its SHA-256, the row that stays, that row's length and the number of rows that
brought the digest in. New rows are grouped by digest (combined before the shuffle, so a group of
copies costs a line per task), taken against the index by a sort-merge anti-join that does not
shuffle the index, and the unseen digests are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import id_and_text, table  # noqa: F401
from lakeops.session import scratch_path

# The characters [\x20\x09-\x0D], which do not count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
SCHEMA = "digest binary, keep_id long, keep_chars int, group_size long"
# At most so many digests are treated as busy: each holds at least this share of all rows.
BUSY_KEYS = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, length in code points and SHA-256 of the text without white space, a row per row."""
    rows = id_and_text(docs, id_col, text_col)
    bare = F.regexp_replace("text", WHITE, "")
    return rows.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
    )


class DigestIndex:
    """The persistent index. ``name`` is its table, ``path`` a folder all executors reach."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """An empty index; in the shared folder unless ``path`` says otherwise."""
        path = path or scratch_path(spark, "digest-index")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, f"digest_index_{uuid.uuid4().hex}", path, buckets)
        index._append(spark.createDataFrame([], SCHEMA))
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int):
        """An index that another session wrote; ``buckets`` as it was created with."""
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({SCHEMA}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        return cls(spark, name, path, buckets)

    def _append(self, entries: DataFrame) -> None:
        (
            entries.write.mode("append")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Appends the digests of ``docs`` that the index does not hold.

        Of equal texts the row with the most code points stays, then the smallest id; a null id
        comes last, a null text counts as empty. A digest that is held keeps its entry.
        """
        order = F.struct(
            (-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")
        )
        groups = (
            digests(docs, id_col, text_col)
            .groupBy("digest")
            .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select(
                "digest",
                F.col("first.id").alias("keep_id"),
                (-F.col("first.shorter")).alias("keep_chars"),
                "group_size",
            )
            .repartition(self.buckets, "digest")
        )
        held = self.entries().select("digest").hint("merge")
        self._append(groups.join(held, "digest", "left_anti"))

    def label(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A line per row: doc_id, keep_id, group_size, kept, text_sha256.

        ``group_size`` counts the rows of the batch that brought the digest in. Rows that repeat
        both id and text share their fate. Digests that hold a large share of all rows (at most
        ``BUSY_KEYS`` of them, by that share) are broadcast; their rows then join under a key of
        their own, so that they spread over all tasks.
        """
        total = self.entries().agg(F.sum("group_size")).first()[0] or 0
        share = max(100, -(-total // BUSY_KEYS))
        busy = self.entries().where(F.col("group_size") >= share)
        busy = busy.select(*[F.col(c).alias(f"busy_{c}") for c in busy.columns])
        rows = digests(docs, id_col, text_col)
        rows = rows.join(F.broadcast(busy), rows["digest"] == busy["busy_digest"], "left")
        spread = F.unhex(F.sha2(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary"), 224))
        rows = rows.withColumn("key", F.when(F.col("busy_digest").isNull(), F.col("digest")).otherwise(spread))
        held = self.entries().withColumnRenamed("digest", "held")
        joined = rows.join(held, rows["key"] == held["held"], "left")
        keep_id = F.when(F.col("busy_digest").isNotNull(), F.col("busy_keep_id")).otherwise(F.col("keep_id"))
        chars = F.coalesce("busy_keep_chars", "keep_chars")
        return joined.select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.coalesce("busy_group_size", "group_size").alias("group_size"),
            (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == chars)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the first batch of a new index, every row labelled (see ``DigestIndex``)."""
    index = DigestIndex.create(docs.sparkSession)
    index.add(docs, id_col, text_col)
    return index.label(docs, id_col, text_col)
