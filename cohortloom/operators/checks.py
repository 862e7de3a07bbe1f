"""Data-quality checks as queries.

A check yields one row ``(check_name, level, code, n, examples)`` where ``n``
counts offenders and ``examples`` names the first five. Checks are unioned, run
in one action, and ``require`` raises when an error-level one found something.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.ids import key_problem, normalize_label
from ..functions.numeric import as_number, is_finite

EXAMPLES = 5

# Column contracts of the public tables.
CONTRACTS = {
    "scores": ("sample", "tumor_probability", "call"),
    "labels": ("sample", "label"),
    "thresholds": (
        "threshold_name", "threshold", "accuracy", "f1", "precision", "recall",
        "specificity", "tn", "fp", "fn", "tp", "youden_j",
    ),
    "explanations": (
        "sample", "tumor_probability", "logit", "direction", "rank", "gene_id", "gene_name",
        "contribution_logit", "expression_log2_tpm1", "training_mean", "scaled_value", "lr_coef",
    ),
    "gene_metadata": (
        "rank_abs_lr_coef", "gene_id", "gene_id_base", "gene_name", "lr_coef", "abs_lr_coef",
        "direction_if_high", "scaler_mean", "scaler_scale",
    ),
}

# Columns of the thresholds table that may be empty but hold shares otherwise.
THRESHOLD_NUMBERS = ("threshold", "accuracy", "f1", "precision", "recall", "specificity", "youden_j")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def offenders(df: DataFrame, example: Column | str, check: str, code: str, level: str = "ERROR") -> DataFrame:
    """Summarise offending rows: their number and the first five examples.

    The count is a plain aggregate and the examples a bounded top-5, so no
    task ever gathers all offenders.
    """
    example = F.col(example) if isinstance(example, str) else example
    bad = df.select(example.cast("string").alias("example"))
    first = bad.distinct().orderBy("example").limit(EXAMPLES).select(F.lit(0).alias("k"), "example")
    return (
        bad.select(F.lit(1).alias("k"), F.lit(None).cast("string").alias("example"))
        .unionByName(first)
        .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sort_array(F.collect_list("example")).alias("e"))
        .select(
            F.lit(check).alias("check_name"),
            F.lit(level).alias("level"),
            F.lit(code).alias("code"),
            F.col("n").cast("bigint").alias("n"),
            F.array_join("e", ", ").alias("examples"),
        )
    )


def counted(df: DataFrame, rules: dict[tuple[str, str, str], Column]) -> DataFrame:
    """Row-wise rules in one pass: ``{(check, level, code): violated}``."""
    keys = list(rules)
    totals = df.agg(*[F.count_if(rules[k]).alias(f"c{i}") for i, k in enumerate(keys)])
    rows = F.array(
        *[
            F.struct(
                F.lit(k[0]).alias("check_name"),
                F.lit(k[1]).alias("level"),
                F.lit(k[2]).alias("code"),
                F.col(f"c{i}").alias("n"),
                F.lit("").alias("examples"),
            )
            for i, k in enumerate(keys)
        ]
    )
    return totals.select(F.inline(rows))


def require(issues: DataFrame, context: str) -> None:
    found = issues.where("level = 'ERROR' and n > 0").orderBy("check_name", "code").collect()
    if found:
        text = "; ".join(f"{r['check_name']}: {r['code']} ({r['n']})" + (f" {r['examples']}" if r["examples"] else "") for r in found)
        raise ValueError(f"{context}: {text}")


# --- identifiers -----------------------------------------------------------


def offenders_by_kind(bad: DataFrame, check: str, kinds: Sequence[str]) -> DataFrame:
    """One row per kind from ``bad(kind, example, n)``: totals and five examples.

    The limit inside the window is applied in every task before the shuffle, so
    a kind with any number of offenders sends five rows per task.
    """
    w = Window.partitionBy("kind").orderBy("example")
    first = bad.where("example is not null").select("kind", "example").distinct().withColumn("at", F.row_number().over(w)).where(F.col("at") <= EXAMPLES)
    spark = bad.sparkSession
    parts = [
        bad.groupBy("kind").agg(F.sum("n").alias("n")).withColumn("example", F.lit(None).cast("string")),
        first.select("kind", F.lit(0).cast("bigint").alias("n"), "example"),
        spark.createDataFrame([(k, 0, None) for k in kinds], "kind string, n bigint, example string"),
    ]
    return (
        union_all(parts)
        .groupBy("kind")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("example")).alias("e"))
        .select(
            F.lit(check).alias("check_name"), F.lit("ERROR").alias("level"), F.col("kind").alias("code"), "n", F.array_join("e", ", ").alias("examples")
        )
    )


def key_issues(df: DataFrame, column: str) -> DataFrame:
    """Missing, blank and padded identifiers; padding is refused, never trimmed."""
    bad = df.select(key_problem(column).alias("kind"), F.concat(F.lit("["), F.col(column), F.lit("]")).alias("example"), F.lit(1).cast("bigint").alias("n"))
    return offenders_by_kind(bad.where("kind is not null"), column, ("missing", "blank", "padded"))


def duplicate_issues(df: DataFrame, column: str) -> DataFrame:
    repeated = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return offenders(repeated, column, column, "duplicate")


def unique_key_issues(df: DataFrame, column: str) -> DataFrame:
    """All identifier rules over one grouping of the key column."""
    keys = df.groupBy(F.col(column).alias("example")).agg(F.count("*").alias("copies"))
    kind = F.coalesce(key_problem("example"), F.when(F.col("copies") > 1, F.lit("duplicate")))
    bad = keys.select(kind.alias("kind"), "example", F.lit(1).cast("bigint").alias("n")).where("kind is not null")
    return offenders_by_kind(bad, column, ("missing", "blank", "padded", "duplicate"))


def matrix_issues(rows: DataFrame, header: DataFrame) -> DataFrame:
    """Both axes non-empty, unique and clean. ``header(pos, gene_id)``."""
    sizes = rows.agg(F.count("*").alias("m")).select(F.lit("sample").alias("axis"), "m").union(
        header.agg(F.count("*")).select(F.lit("gene_id"), F.col("count(1)"))
    )
    empty = sizes.select(
        F.col("axis").alias("check_name"),
        F.lit("ERROR").alias("level"),
        F.lit("empty").alias("code"),
        F.when(F.col("m") == 0, 1).otherwise(0).cast("bigint").alias("n"),
        F.lit("").alias("examples"),
    )
    return union_all([unique_key_issues(rows, "sample"), unique_key_issues(header, "gene_id"), empty])


def label_issues(df: DataFrame, column: str) -> DataFrame:
    return offenders(df.where(normalize_label(column).isNull()), column, column, "unrecognized_label")


def gene_metadata_issues(df: DataFrame) -> DataFrame:
    """Clean ids, and one name per id and per version-free id."""
    names = df.select(
        F.explode(F.array_distinct(F.array("gene_id", "gene_id_base"))).alias("key"),
        F.coalesce("gene_name", F.lit("")).alias("gene_name"),
    )
    conflicting = names.groupBy("key").agg(
        F.min("gene_name").alias("first_name"), F.max("gene_name").alias("last_name")
    ).where("first_name <> last_name")
    unclean = df.where(key_problem("gene_id").isNotNull() | key_problem("gene_id_base").isNotNull())
    return offenders(unclean, "gene_id", "gene_metadata", "unclean_id").unionByName(
        offenders(conflicting, "key", "gene_metadata", "conflicting_name")
    )


# --- values ----------------------------------------------------------------


def probability_issues(df: DataFrame, column: str, check: str | None = None) -> DataFrame:
    p = as_number(column)
    finite = is_finite(p)
    return counted(
        df,
        {
            (check or column, "ERROR", "non_numeric_probability"): ~finite,
            (check or column, "ERROR", "probability_out_of_range"): finite & ((p < 0) | (p > 1)),
        },
    )


def metric_input_issues(df: DataFrame, label: str, score: str, both_classes: bool = False) -> DataFrame:
    """Labels 0/1, finite scores, at least one row, both classes on request."""
    y = as_number(label)
    totals = df.agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce((y == 0) | (y == 1), F.lit(False))).alias("bad_label"),
        F.count_if(~is_finite(as_number(score))).alias("bad_score"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(y == 0).alias("neg"),
    )
    one_class = F.when((F.col("pos") == 0) | (F.col("neg") == 0), 1).otherwise(0) if both_classes else F.lit(0)
    rows = [
        ("empty", F.when(F.col("n") == 0, 1).otherwise(0)),
        ("non_binary_label", F.col("bad_label")),
        ("non_finite_score", F.col("bad_score")),
        ("single_class", one_class),
    ]
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("metric_inputs").alias("check_name"),
                        F.lit("ERROR").alias("level"),
                        F.lit(code).alias("code"),
                        n.cast("bigint").alias("n"),
                        F.lit("").alias("examples"),
                    )
                    for code, n in rows
                ]
            )
        )
    )


def scored_issues(df: DataFrame) -> DataFrame:
    return unique_key_issues(df, "sample").unionByName(probability_issues(df, "tumor_probability"))


# --- output tables ---------------------------------------------------------


def contract_issues(df: DataFrame, contract: str) -> DataFrame:
    """Column order, id rules and value domains of a public table."""
    expected = CONTRACTS[contract]
    spark = df.sparkSession
    same = tuple(df.columns) == expected
    schema = "check_name string, level string, code string, n bigint, examples string"
    parts = [
        spark.createDataFrame([(contract, "ERROR", "column_contract_mismatch", 0 if same else 1, "")], schema)
    ]
    have = set(df.columns)
    rules: dict[tuple[str, str, str], Column] = {}

    def number(c):
        return as_number(c)

    if contract in ("scores", "labels") and "sample" in have:
        parts.append(unique_key_issues(df, "sample"))
    if contract in ("scores", "explanations") and "tumor_probability" in have:
        parts.append(probability_issues(df, "tumor_probability", contract))
    if contract == "scores" and "call" in have:
        rules[contract, "ERROR", "invalid_call_value"] = ~F.coalesce(F.col("call").isin("tumor", "normal"), F.lit(False))
    if contract == "labels" and "label" in have:
        rules[contract, "ERROR", "invalid_label_value"] = ~F.coalesce(
            F.col("label").cast("string").isin("tumor", "normal", "1", "0"), F.lit(False)
        )
    if contract == "thresholds":
        for c in ("tn", "fp", "fn", "tp"):
            if c in have:
                rules[f"{contract}.{c}", "ERROR", "non_numeric_count"] = number(c).isNull()
                rules[f"{contract}.{c}", "ERROR", "negative_count"] = number(c) < 0
        for c in THRESHOLD_NUMBERS:
            if c in have:
                given = F.col(c).isNotNull() & ~F.coalesce(F.isnan(number(c)), F.lit(False))
                rules[f"{contract}.{c}", "ERROR", "non_numeric_metric"] = given & number(c).isNull()
                rules[f"{contract}.{c}", "ERROR", "metric_out_of_range"] = given & ~number(c).between(0, 1)
        if "threshold_name" in have:
            present = df.where(F.col("threshold_name").isin("default", "youden_j")).agg(
                F.count_distinct("threshold_name").alias("k")
            )
            parts.append(
                present.select(
                    F.lit(contract).alias("check_name"),
                    F.lit("ERROR").alias("level"),
                    F.lit("threshold_rows_missing").alias("code"),
                    (2 - F.col("k")).alias("n"),
                    F.lit("").alias("examples"),
                )
            )
    if contract == "explanations":
        if "direction" in have:
            rules[contract, "ERROR", "invalid_explanation_direction"] = ~F.coalesce(
                F.col("direction").isin("tumor", "normal"), F.lit(False)
            )
        if "rank" in have:
            rules[contract, "ERROR", "invalid_explanation_rank"] = ~F.coalesce(number("rank") >= 1, F.lit(False))
    if contract == "gene_metadata":
        if "gene_id" in have:
            parts.append(duplicate_issues(df, "gene_id"))
        if "direction_if_high" in have:
            rules[contract, "ERROR", "invalid_model_gene_direction"] = ~F.coalesce(
                F.col("direction_if_high").isin("tumor", "normal"), F.lit(False)
            )
        if "scaler_scale" in have:
            rules[contract, "ERROR", "invalid_scaler_scale"] = ~F.coalesce(number("scaler_scale") > 0, F.lit(False))
    if rules:
        parts.append(counted(df, rules))
    return union_all(parts)


def score_consistency(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row comparing two score tables sample by sample."""
    a = left.select("sample", F.col("tumor_probability").alias("p_left"), F.col("call").alias("call_left"))
    b = right.select("sample", F.col("tumor_probability").alias("p_right"), F.col("call").alias("call_right"))
    return a.join(b, "sample", "full_outer").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("p_right").isNull()).alias("n_only_left"),
        F.count_if(F.col("p_left").isNull()).alias("n_only_right"),
        F.max(F.abs(F.col("p_left") - F.col("p_right"))).alias("max_abs_delta"),
        F.count_if(F.col("call_left") != F.col("call_right")).alias("n_call_changes"),
    ).withColumn(
        "consistent",
        (F.col("n_only_left") == 0)
        & (F.col("n_only_right") == 0)
        & (F.coalesce("max_abs_delta", F.lit(0.0)) <= tolerance)
        & (F.col("n_call_changes") == 0),
    )


# --- sets of names ---------------------------------------------------------


def missing_names(wanted: DataFrame, have: DataFrame, column: str) -> DataFrame:
    """Names asked for and not there."""
    return wanted.select(column).distinct().join(have.select(column).distinct(), column, "left_anti")


def require_columns(df: DataFrame, columns: Sequence[str], context: str) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"{context} is missing required columns: {', '.join(absent)}")


def names_frame(spark: SparkSession, column: str, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField(column, T.StringType())]))
