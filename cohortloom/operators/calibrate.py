"""Labels on scores, threshold calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import normalize_label
from ..functions.numeric import check_fraction
from ..session import materialize
from .checks import CONTRACTS, label_issues, probability_issues, require, require_columns, unique_key_issues
from .metrics import histogram_sweep, rates, with_rates
from .ranking import auc_column, score_histogram, running_sums, youden_counts

SMALL_CLASS = 10
# Fixed value: what a calibration on its own samples may be called.
EVALUATION_TYPE = "apparent_resubstitution"


def label_match(scores: DataFrame, labels: DataFrame, sample: str = "sample") -> DataFrame:
    """One row: scored, labels, matched, unmatched, extra, match fraction."""
    a = scores.select(sample, F.lit(1).alias("has_score"))
    b = labels.select(sample, F.lit(1).alias("has_label"))
    return a.join(b, sample, "full_outer").agg(
        F.count("has_score").alias("n_scores"),
        F.count("has_label").alias("n_labels"),
        F.count_if(F.col("has_score").isNotNull() & F.col("has_label").isNotNull()).alias("n_matched"),
        F.count_if(F.col("has_label").isNull()).alias("n_unmatched"),
        F.count_if(F.col("has_score").isNull()).alias("n_extra"),
    ).withColumn("match_fraction", F.coalesce(F.try_divide(F.col("n_matched").cast("double"), F.col("n_scores").cast("double")), F.lit(0.0)))


def join_labels(scores: DataFrame, labels: DataFrame, sample: str = "sample", label: str = "label") -> DataFrame:
    """Inner join; a label column already on the scores does not clash."""
    own = labels.select(F.col(sample), normalize_label(label).alias("label_binary"))
    return scores.select(sample, "tumor_probability").join(own, sample)


def attach_labels(scores: DataFrame, labels: DataFrame | None, min_match_fraction: float = 1.0, sample: str = "sample", label: str = "label") -> DataFrame:
    """Checked one-to-one join; too few matches or one class is an error."""
    if not 0 < min_match_fraction <= 1:
        raise ValueError("min_match_fraction must be in (0, 1]")
    if sample == label or label == "tumor_probability":
        raise ValueError("sample, label and tumor_probability must be different columns")
    require_columns(scores, [sample, "tumor_probability"], "scores")
    require(unique_key_issues(scores, sample).unionByName(probability_issues(scores, "tumor_probability")), "scores")
    if labels is None:
        require_columns(scores, [label], "scores")
        require(label_issues(scores, label), "scores")
        joined = scores.withColumn("label_binary", normalize_label(label))
    else:
        require_columns(labels, [sample, label], "labels")
        require(unique_key_issues(labels, sample), "labels")
        m = label_match(scores, labels, sample).head()
        if m["match_fraction"] < min_match_fraction:
            raise ValueError(f"only {m['n_matched']} of {m['n_scores']} scores have a label; wanted a share of {min_match_fraction:g}")
        require(label_issues(labels.join(scores.select(sample), sample, "left_semi"), label), "labels")
        joined = join_labels(scores, labels, sample, label)
    if joined.select("label_binary").distinct().count() < 2:
        raise ValueError("labels must cover both classes")
    return joined


def reindex_labels(samples: DataFrame, labels: DataFrame, sample: str = "sample", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Labels for every sample (null where absent) and the match statistics.

    Repeated or blank ids on either side and labels of unknown spelling are refused.
    """
    require_columns(labels, [sample, label], "labels")
    require(unique_key_issues(labels, sample).unionByName(label_issues(labels, label)), "labels")
    require(unique_key_issues(samples, sample), "samples")
    own = labels.select(sample, normalize_label(label).alias("label_binary"))
    stats = label_match(samples, labels, sample).select(
        "n_labels", F.col("n_matched").alias("n_labeled"), F.col("n_unmatched").alias("n_unmatched_samples"), F.col("n_extra").alias("n_extra_labels")
    )
    return samples.join(own, sample, "left"), stats


def threshold_table(labelled: DataFrame, default: float = 0.5, extra: Sequence[float] = (), label: str = "label_binary", score: str = "tumor_probability") -> DataFrame:
    """Rows ``default``, ``youden_j`` and one per extra threshold."""
    return _thresholds(score_histogram(labelled, label, score), default, extra)


def _thresholds(hist: DataFrame, default: float, extra: Sequence[float]) -> DataFrame:
    named = [("default", check_fraction(default))] + [(f"threshold_{check_fraction(t):g}", t) for t in extra]
    columns = [c for c in CONTRACTS["thresholds"] if c != "youden_j"]
    fixed = histogram_sweep(hist, named).select(*columns, F.lit(None).cast("double").alias("youden_j"))
    ranks = running_sums(hist, [], "score", ["pos", "neg"])
    best = with_rates(youden_counts(ranks), ["accuracy", "f1", "precision", "recall", "specificity"])
    return fixed.unionByName(best.select(F.lit("youden_j").alias("threshold_name"), *columns[1:], "youden_j"))


def calibration_summary(labelled: DataFrame, label: str = "label_binary", score: str = "tumor_probability", small_class: int = SMALL_CLASS) -> DataFrame:
    """One row: class counts, AUC, recommended cutoff, small-class warning."""
    return _summary(score_histogram(labelled, label, score), small_class)


def _summary(hist: DataFrame, small_class: int) -> DataFrame:
    ranks = running_sums(hist, [], "score", ["pos", "neg"])
    auc = ranks.agg(auc_column().alias("auc"))
    best = youden_counts(ranks).withColumn("accuracy", rates()["accuracy"]).withColumn("recall", rates()["recall"]).withColumn("specificity", rates()["specificity"])
    merged = auc.unionByName(best, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("auc", "threshold", "tn", "fp", "fn", "tp", "accuracy", "recall", "specificity")])
    n_tumor, n_normal = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    small = F.least(n_tumor, n_normal) < small_class
    text = F.format_string(
        f"a class has fewer than {small_class} labeled samples (tumor %d, normal %d): expect unstable metrics",
        n_tumor, n_normal,
    )
    return merged.select(
        (n_tumor + n_normal).alias("n"),
        n_tumor.alias("n_tumor"),
        n_normal.alias("n_normal"),
        "auc",
        F.col("threshold").alias("recommended_threshold"),
        F.lit("youden_j").alias("recommended_metric"),
        F.col("accuracy").alias("recommended_accuracy"),
        F.col("recall").alias("recommended_recall"),
        F.col("specificity").alias("recommended_specificity"),
        F.lit(EVALUATION_TYPE).alias("evaluation_type"),
        F.when(small, F.array(text)).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def calibrate(scores: DataFrame, labels: DataFrame | None, extra: Sequence[float] = (), default: float = 0.5, min_match_fraction: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Threshold table and summary of labelled scores, from one histogram."""
    labelled = attach_labels(scores, labels, min_match_fraction)
    hist = materialize(score_histogram(labelled, "label_binary", "tumor_probability"), "score-histogram")
    return _thresholds(hist, default, extra), _summary(hist, SMALL_CLASS)
