"""Exact dedup: a persistent index of digests, bucketed and sorted by digest.

Column expressions only. New rows are reduced to one row per digest in the tasks
that read them, the digests that the index has are dropped by a sort-merge
anti-join (the index side needs no shuffle), and the others are appended.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path
from .rows import kept_once

FORMAT = "sha256-keep-1"
_COLUMNS = "digest binary, keep_id bigint, keep_row bigint, keep_batch string"


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256))


class DigestIndex:
    """The first keeper of every text seen so far, stored at ``path``.

    The folder outlives the session. Its ``spec`` states the number of buckets it was made
    with; opening it again, in any session, uses that number. ``buckets`` (the session's
    shuffle partitions where not given) counts for a new index only, and is refused where
    it differs from an old one's, as is another format. The catalog's name for the table
    is a hash of the whole path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        path = path.rstrip("/")
        self.spark, self.path = spark, path
        self.buckets = self._stored() or self._made(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"create table if not exists {self.table} ({_COLUMNS}) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}/entries'"
        )
        spark.catalog.refreshTable(self.table)

    def _stored(self) -> int | None:
        """The number of buckets that the folder states; none where there is no index yet."""
        try:
            found = self.spark.read.schema("format string, buckets int").json(f"{self.path}/spec").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if len(found) != 1 or found[0]["format"] != FORMAT or not found[0]["buckets"]:
            raise ValueError(f"{self.path} holds no index of format {FORMAT}: {found[:2]}")
        return found[0]["buckets"]

    def _made(self, buckets: int) -> int:
        self.spark.createDataFrame([(FORMAT, buckets)], "format string, buckets int").coalesce(1).write.json(f"{self.path}/spec")
        return buckets

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> None:
        """Append the digests that the index lacks; of equal ones the largest (id, row) is kept.

        ``digests`` holds ``row, doc_id, digest, batch``; row numbers count within a batch.
        """
        best = F.max(F.struct("doc_id", "row", "batch"))
        new = digests.groupBy("digest").agg(best.alias("best")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.batch").alias("keep_batch"))
        fresh = new.join(self.entries().hint("merge"), "digest", "left_anti")
        fresh.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digests_of(docs: DataFrame) -> DataFrame:
    """``row, doc_id, digest, batch`` of each row, written once so that row numbers hold; every call is a batch of its own."""
    batch = F.lit(uuid.uuid4().hex).alias("batch")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), batch)
    return materialize(rows, "digests")


def classes(digests: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Add ``digests`` to ``index`` and return ``digest, keep_id, keep_row, keep_batch, group_size``.

    Batches are ranges of doc_id, the highest first, so that the first keeper of a
    text is also the one with the largest id. A null id counts as lowest.
    """
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [low + (high - low) * i // batches for i in range(1, batches)] if low is not None else []
    number = F.lit(0)
    for c in cuts:
        number = number + (F.coalesce(F.col("doc_id"), F.lit(low)) > c).cast("int")
    for b in range(len(cuts), -1, -1):
        index.add(digests.where(number == b) if cuts else digests)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    return materialize(sizes.join(index.entries().hint("merge"), "digest"), "classes")


def dedup(docs: DataFrame, path: str | None = None, batches: int = 2) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row of ``docs``.

    Texts are equal when identical; null counts as empty. The largest doc_id stays;
    of rows that repeat both id and text exactly one is kept. A null id loses to any
    other. Further columns are ignored, an empty table gives an empty one.

    The last join brings a hot text's copies together by key; both sides are plain
    shuffles of a few dozen bytes a row, which Spark splits where a key is skewed.
    """
    return _verdicts(docs, path, batches).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _verdicts(docs: DataFrame, path: str | None, batches: int) -> DataFrame:
    spark = docs.sparkSession
    digests = digests_of(docs)
    index = DigestIndex(spark, path or scratch_path(spark, "index"))
    found = classes(digests, index, batches)
    joined = digests.join(found, "digest")
    kept = F.col("row").eqNullSafe(F.col("keep_row")) & F.col("batch").eqNullSafe(F.col("keep_batch"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "row")


def kept_rows(docs: DataFrame, path: str | None = None, batches: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = materialize(_verdicts(docs, path, batches).select("doc_id", "digest", "kept"), "verdicts")
    marks = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept")
    marks = materialize(marks.select("doc_id", F.col("digest").alias("key"), "n"), "kept")
    return kept_once(docs, digest(F.col("text")), marks)
