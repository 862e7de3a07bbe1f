"""Bringing verdicts about documents back to their whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def kept_once(docs: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and ``key`` are in ``marks``, with all their columns.

    ``marks`` holds ``doc_id, key, n``: each pair once, with the number of rows that
    have it. One row stays of those that repeat both; they alone are grouped.
    """
    marks = marks.select(F.col("doc_id").alias("__kept_id"), F.col("key").alias("__kept_key"), F.col("n").alias("__kept_n"))
    keyed = docs.withColumn("__row_key", key)
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__row_key") == F.col("__kept_key"))
    once = keyed.join(marks.where("__kept_n = 1"), same, "left_semi")
    if marks.where("__kept_n > 1").limit(1).count():
        once = once.unionByName(keyed.join(marks.where("__kept_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__row_key"]))
    return once.select(*[f"`{c}`" for c in docs.columns])
