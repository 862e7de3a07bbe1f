"""Standardise and score aligned samples. Row-local: no shuffle in any mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import (
    argmax_class,
    array_sum,
    call as call_at,
    check_fraction,
    double_array,
    is_finite,
    sigmoid,
    softmax,
    string_array,
)
from ..session import small_side
from ..sources.matrix import ExpressionMatrix
from .align import Aligned, align, alignment_issues, alignment_report, gene_match_issues, worst_invalid
from .model import LinearModel, require_tumor_model

MODES = ("none", "cohort_zscore", "cohort_center")


@dataclass(frozen=True)
class CohortStats:
    """Per-gene mean and population sd of one imputed cohort (sd 0 becomes 1)."""

    mean: tuple[float, ...]
    sd: tuple[float, ...]


def standardize(x: Column | str, model: LinearModel, mode: str = "none", stats: CohortStats | None = None) -> Column:
    """z values; null cells (missing or invalid) must be imputed before cohort modes.

    In mode ``none`` a null cell means the training mean, so its z is 0.
    """
    if mode not in MODES:
        raise ValueError(f"unknown adapt mode {mode!r}; choose from {MODES}")
    center = model.mean if mode == "none" else stats.mean
    spread = stats.sd if mode == "cohort_zscore" else model.scale
    centered = F.zip_with(x, double_array(center), lambda v, m: v - m)
    return F.zip_with(centered, double_array(spread), lambda v, s: F.coalesce(v / s, F.lit(0.0)))


def linear_terms(z: Column | str, coef) -> Column:
    return F.zip_with(z, double_array(coef), lambda v, c: v * c)


def logits(z: str, model: LinearModel) -> Column:
    """One logit (two-class) or an array of logits, from a z column."""
    sums = [array_sum(linear_terms(z, c)) + F.lit(float(b)) for c, b in zip(model.coef, model.intercept)]
    return sums[0] if model.kind == "binary" else F.array(*sums)


def checked_logit(c: Column) -> Column:
    return F.when(is_finite(c), c).otherwise(F.raise_error(F.lit("model logits are non-finite")).cast("double"))


def score_aligned(a: Aligned, mode: str = "none", stats: CohortStats | None = None) -> DataFrame:
    """``sample`` plus ``probability`` (double, or array for many classes)."""
    if mode != "none" and stats is None:
        from .adapt import cohort_stats

        stats = cohort_stats(a)
    x = F.col("x") if mode == "none" else a.imputed()
    keep = [c for c in a.rows.columns if c != "x"]
    scored = a.rows.select(*keep, standardize(x, a.model, mode, stats).alias("z")).select(
        *keep, logits("z", a.model).alias("logit")
    )
    if a.model.kind == "binary":
        p = sigmoid(checked_logit(F.col("logit")))
    else:
        p = softmax(F.transform("logit", checked_logit))
    return scored.select(*keep, p.alias("probability"))


def guard(a: Aligned, max_invalid_fraction: float = 0.0, allow_invalid: bool = False, min_match_rate: float = 0.5, allow_low_coverage: bool = False) -> None:
    """Refuse before any output: gene coverage on the header, then invalid cells.

    Coverage needs no data. A clean cohort takes one aggregate; the full report
    is only made when there is something to report.
    """
    check_fraction(max_invalid_fraction, "max_invalid_cell_fraction")
    check_fraction(min_match_rate, "min_model_gene_match_rate")
    rate = a.n_matched / len(a.positions)
    if not allow_low_coverage and rate < min_match_rate:
        raise ValueError(f"gene coverage: the input has {a.n_matched} of {len(a.positions)} model genes, wanted a share of {min_match_rate:g}")
    if not allow_invalid and worst_invalid(a):
        found = alignment_issues(alignment_report(a), max_invalid_fraction).collect()
        if found:
            raise ValueError("invalid cells: " + "; ".join(r["message"] for r in found))


def guard_issues(a: Aligned, max_invalid_fraction: float = 0.0, min_match_rate: float = 0.5) -> DataFrame:
    report = alignment_report(a)
    return gene_match_issues(report, min_match_rate).unionByName(alignment_issues(report, max_invalid_fraction))


def predict_proba(
    model: LinearModel,
    matrix: ExpressionMatrix,
    mode: str = "none",
    max_invalid_fraction: float = 0.0,
    allow_invalid: bool = False,
    min_match_rate: float = 0.5,
    allow_low_coverage: bool = False,
) -> DataFrame:
    a = align(matrix, model)
    guard(a, max_invalid_fraction, allow_invalid, min_match_rate, allow_low_coverage)
    return score_aligned(a, mode)


def binary_scores(probabilities: DataFrame, threshold: float = 0.5, round_digits: int | None = None) -> DataFrame:
    """``sample, tumor_probability, call``; the call follows the value shown."""
    threshold = check_fraction(threshold)
    p = F.col("probability") if round_digits is None else F.round("probability", round_digits)
    keep = [c for c in probabilities.columns if c not in ("sample", "probability")]
    return probabilities.select("sample", *keep, p.alias("tumor_probability")).withColumn(
        "call", call_at("tumor_probability", threshold)
    )


def score_binary(model: LinearModel, matrix: ExpressionMatrix, threshold: float = 0.5, round_digits: int | None = None, **guards) -> DataFrame:
    check_fraction(threshold)
    return binary_scores(predict_proba(require_tumor_model(model), matrix, **guards), threshold, round_digits)


def predict(model: LinearModel, matrix: ExpressionMatrix, threshold: float = 0.5, **guards) -> DataFrame:
    """Hard labels of a two-class or a many-class model."""
    check_fraction(threshold)
    scored = predict_proba(model, matrix, **guards)
    if model.kind == "binary":
        label = call_at("probability", threshold, model.classes[1], model.classes[0])
    else:
        label = argmax_class("probability", model.classes)
    return scored.select("sample", label.alias("predicted"))


def top_classes(scored: DataFrame, model: LinearModel, k: int = 3) -> DataFrame:
    """Best class, its probability to 4 digits, and ``CLASS:0.123`` for the k best.

    Ordering by negated probability then class position keeps class order on ties.
    """
    k = min(k, len(model.classes))
    ranked = F.array_sort(
        F.zip_with(
            F.transform("probability", lambda p, i: F.struct((-p).alias("neg"), i.alias("i"))),
            string_array(model.classes),
            lambda s, c: F.struct(s["neg"].alias("neg"), s["i"].alias("i"), c.alias("cls")),
        )
    )
    best = scored.select("sample", F.slice(ranked, 1, k).alias("best"))
    item = [F.get("best", F.lit(i)) for i in range(k)]
    return best.select(
        "sample",
        item[0]["cls"].alias("predicted_type"),
        F.round(-item[0]["neg"], 4).alias("probability"),
        *[F.format_string("%s:%.3f", b["cls"], -b["neg"]).alias(f"top{i}") for i, b in enumerate(item, 1)],
    )


def predict_cancer_type(model: LinearModel, matrix: ExpressionMatrix, topk: int = 3, **guards) -> DataFrame:
    return top_classes(predict_proba(model, matrix, **guards), model, topk)


def call_distribution(predictions: DataFrame, column: str = "predicted_type") -> DataFrame:
    return predictions.groupBy(column).agg(F.count("*").alias("n"))


def model_dot(long: DataFrame, genes: DataFrame, coef: DataFrame) -> DataFrame:
    """Linear predictor over long cells: join the model, sum per sample and class.

    ``long(sample, pos, value)``; a null value adds 0. Rows of one sample add up
    inside a task before the shuffle.
    """
    weights = coef.join(genes.select("pos", "mean", "scale"), "pos")
    return (
        long.join(small_side(weights), "pos")
        .groupBy("sample", "class_idx")
        .agg(F.sum(F.coalesce((F.col("value") - F.col("mean")) / F.col("scale") * F.col("coef"), F.lit(0.0))).alias("dot"))
    )
