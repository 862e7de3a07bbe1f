"""Side tables, reports and input snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numeric import finite_or_null
from ..operators.checks import require_columns

PHENOTYPE_COLUMNS = ("sample", "_study", "_sample_type", "_primary_site")


def read_table(spark: SparkSession, path: str, string_columns: Sequence[str] = (), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a clean header. Named columns and all other text stay text.

    ``NA`` and leading zeros survive: only columns that are numbers throughout,
    and are not named, become numbers. Every part must have the same header and all
    rows its width; reading refuses others.
    """
    raw = spark.read.option("encoding", encoding).csv(path, header=False, sep=sep, quote='"', escape='"', inferSchema=False, nullValue="\u0000", emptyValue="").limit(1)
    first = raw.head()
    if first is None:
        raise ValueError(f"table {path} is empty")
    names = [("" if v is None else v) for v in first]
    names[0] = names[0].lstrip("﻿")
    if any(not n.strip() for n in names):
        raise ValueError(f"table {path} has a blank column name")
    if any(n != n.strip() for n in names):
        raise ValueError(f"table {path} has a padded column name")
    if len(set(names)) != len(names):
        raise ValueError(f"table {path} has a column name twice")
    schema = T.StructType([T.StructField(n or "", T.StringType()) for n in first])
    reader = spark.read.option("encoding", encoding).option("columnPruning", False).schema(schema)
    text = reader.csv(path, header=True, sep=sep, quote='"', escape='"', nullValue="\u0000", emptyValue="", enforceSchema=False, mode="FAILFAST")
    text = text.toDF(*names).select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    free = [n for n in names if n not in string_columns]
    if not free:
        return text
    whole, number = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    kinds = text.agg(
        *[F.bool_and(F.col(f"`{n}`").rlike(whole)).alias(f"i{j}") for j, n in enumerate(free)],
        *[F.bool_and(F.col(f"`{n}`").rlike(number)).alias(f"d{j}") for j, n in enumerate(free)],
    ).head()
    kind = {n: "bigint" if kinds[f"i{j}"] else "double" if kinds[f"d{j}"] else "string" for j, n in enumerate(free)}
    return text.select(*[F.col(f"`{n}`").cast(kind.get(n, "string")).alias(n) for n in names])


def read_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """Provider phenotype TSV in Latin-1, as ``sample, study, sample_type, primary_site, ...``."""
    df = read_table(spark, path, PHENOTYPE_COLUMNS, sep="\t", encoding="ISO-8859-1")
    require_columns(df, PHENOTYPE_COLUMNS, "phenotype table")
    return df.withColumnsRenamed({"_study": "study", "_sample_type": "sample_type", "_primary_site": "primary_site"})


def write_table(df: DataFrame, path: str) -> str:
    """CSV parts with a header and full float precision."""
    df.write.csv(path, header=True, emptyValue="", quote='"', escape='"')
    return path


def finite_only(df: DataFrame) -> DataFrame:
    """Non-finite numbers, also inside structs and arrays, as null."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return finite_or_null(c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda v: clean(v, t.elementType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def report_json(df: DataFrame) -> DataFrame:
    """One strict JSON text per row; nulls are kept as null."""
    clean = finite_only(df)
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report_json"))


def write_report_json(df: DataFrame, path: str) -> str:
    report_json(df).write.text(path)
    return path


def input_snapshot(spark: SparkSession, paths: Sequence[str], mode: str = "content") -> DataFrame:
    """Path, size and fingerprint of every consumed file, the same kind for all.

    ``content`` hashes with SHA-256 and refuses a file that Spark cannot hold as one
    binary value; ``stat`` pins files by modification time and size.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    stat = F.concat(F.lit("stat:"), F.col("modificationTime").cast("string"), F.lit(":"), F.col("length").cast("string"))
    fingerprint = {"content": F.sha2("content", 256), "stat": stat}[mode]
    return listed.select("path", F.col("length").alias("bytes"), fingerprint.alias("fingerprint"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("path", F.col("fingerprint").alias("was"))
    a = after.select("path", F.col("fingerprint").alias("is_now"))
    return b.join(a, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("is_now")))
