"""Nested provider manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import SAMPLE_TYPE_LABELS

HIT_SCHEMA = (
    "file_id string, file_name string, file_size bigint, md5sum string, "
    "cases array<struct<submitter_id:string, project:struct<project_id:string>, "
    "samples:array<struct<submitter_id:string, sample_type:string>>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One hit per JSON line, or a provider response with ``data.hits``."""
    raw = spark.read.schema(f"{HIT_SCHEMA}, data struct<hits:array<struct<{_inner(HIT_SCHEMA)}>>>").json(path)
    single = raw.where("file_id is not null").drop("data")
    nested = raw.where("data is not null").select(F.inline("data.hits"))
    return single.unionByName(nested)


def _inner(ddl: str) -> str:
    return ddl.replace("file_id string", "file_id:string").replace("file_name string", "file_name:string").replace(
        "file_size bigint", "file_size:bigint"
    ).replace("md5sum string", "md5sum:string").replace("cases array", "cases:array")


def _distinct_names(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def manifest_rows(hits: DataFrame) -> DataFrame:
    """One row per hit; names inside a hit are joined with ``;``. Row-local."""
    samples = F.flatten(F.transform("cases", lambda c: F.coalesce(c["samples"], F.array().cast("array<struct<submitter_id:string,sample_type:string>>"))))
    types = _distinct_names(F.transform(samples, lambda s: s["sample_type"]))
    return hits.select(
        "file_id",
        "file_name",
        "file_size",
        "md5sum",
        F.array_join(_distinct_names(F.transform("cases", lambda c: c["project"]["project_id"])), ";").alias("project"),
        F.array_join(_distinct_names(F.transform("cases", lambda c: c["submitter_id"])), ";").alias("case_submitter_id"),
        F.array_join(_distinct_names(F.transform(samples, lambda s: s["submitter_id"])), ";").alias("sample_submitter_id"),
        F.coalesce(F.array_join(types, ";"), F.lit("")).alias("sample_type"),
        F.coalesce(F.size(types), F.lit(0)).alias("n_sample_types"),
    )


def flatten_manifest(hits: DataFrame) -> DataFrame:
    """One row per file with exactly one, supported, sample type.

    Copies of a file are one file: the copy that sorts first is kept.
    """
    rows = manifest_rows(hits)
    rest = [c for c in rows.columns if c != "file_id"]
    first = rows.groupBy("file_id").agg(F.min(F.struct(*rest)).alias("r")).select("file_id", "r.*")
    return first.where((F.col("n_sample_types") == 1) & F.col("sample_type").isin(*SAMPLE_TYPE_LABELS))
