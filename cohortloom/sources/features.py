"""Feature exports: the same matrix in two precisions, and its axes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.ids import key_problem
from ..functions.numeric import is_finite
from ..operators.checks import counted, offenders, require, union_all, unique_key_issues
from .matrix import ExpressionMatrix

PRECISIONS = {"float32": "array<float>", "float64": "array<double>"}


def export_issues(matrix: ExpressionMatrix) -> DataFrame:
    """Finite cells, clean unique axes."""
    bad = F.exists("cells", lambda v: ~is_finite(matrix.numbers(v)))
    return union_all(
        [
            counted(matrix.rows, {("features", "ERROR", "non_finite_row"): bad}),
            unique_key_issues(matrix.rows, "sample"),
            offenders(matrix.header().where(key_problem("gene_id").isNotNull()), "pos", "genes", "unclean"),
        ]
    )


def feature_rows(matrix: ExpressionMatrix, precision: str, generation: str) -> DataFrame:
    cells = F.transform("cells", matrix.numbers).cast(PRECISIONS[precision])
    return matrix.rows.select("sample", cells.alias("x"), F.lit(generation).alias("generation"))


def export_features(matrix: ExpressionMatrix, path: str) -> str:
    """Write both precisions and the gene axis under one generation id."""
    require(export_issues(matrix), "feature export")
    generation = uuid.uuid4().hex
    for precision in PRECISIONS:
        feature_rows(matrix, precision, generation).write.parquet(f"{path}/{precision}")
    matrix.header().withColumn("generation", F.lit(generation)).write.parquet(f"{path}/genes")
    return generation


def read_features(spark: SparkSession, path: str, precision: str = "float64") -> tuple[DataFrame, tuple[str, ...]]:
    x = spark.read.parquet(f"{path}/{precision}")
    genes = spark.read.parquet(f"{path}/genes")
    require(feature_issues(x, genes, precision), path)
    return x, tuple(r["gene_id"] for r in genes.orderBy("pos").collect())


def feature_issues(x: DataFrame, genes: DataFrame, precision: str = "float64", samples: Sequence[str] | None = None) -> DataFrame:
    """Shape equals both axes, element type as declared, one generation."""
    wanted = T.DoubleType() if precision == "float64" else T.FloatType()
    type_ok = x.schema["x"].dataType.elementType == wanted
    both = (
        x.select(F.size("x").alias("w"), "generation", F.lit(1).alias("row"))
        .groupBy("generation")
        .agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("genes"))
        .unionByName(
            genes.groupBy("generation").agg(
                F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("genes")
            )
        )
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"), F.sum("genes").alias("genes"),
            F.count_distinct("generation").alias("generations"),
        )
    )
    expected_rows = F.lit(len(samples)) if samples is not None else F.col("rows")
    shape_ok = (F.col("lo") == F.col("genes")) & (F.col("hi") == F.col("genes")) & (F.col("rows") > 0) & (F.col("rows") == expected_rows)
    return counted(
        both,
        {
            ("features", "ERROR", "shape_mismatch"): ~F.coalesce(shape_ok, F.lit(False)),
            ("features", "ERROR", "element_type"): F.lit(not type_ok),
            ("features", "ERROR", "mixed_generations"): F.col("generations") != 1,
        },
    )
