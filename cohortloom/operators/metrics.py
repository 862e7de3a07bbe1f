"""Classification metrics as aggregations, grouped or global."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from .ranking import (
    auc_column,
    average_precision_column,
    binary_label,
    exact_quantiles,
    finite_score,
    interpolate,
    present_class,
    rank_values,
    running_sums,
    score_histogram,
    score_ranks,
    youden_counts,
)

# Named threshold presets of the two labelled cohorts.
PRESETS = {
    "native": [
        ("default_0.5", 0.5), ("youden_j", None), ("high_specificity_0.75", 0.75), ("high_specificity_0.9", 0.9),
        ("high_specificity_0.95", 0.95), ("very_high_specificity_0.99", 0.99),
    ],
    "foreign": [
        ("default_0.5", 0.5), ("youden_j", None), ("high_0.99", 0.99), ("high_0.999", 0.999),
        ("high_0.9999", 0.9999), ("high_0.99999", 0.99999),
    ],
}
# Thresholds of the all-normal sweep.
ALL_NORMAL_THRESHOLDS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999, 0.999975, 0.99999, 0.999999)
# Quantiles of the per-type score table.
TYPE_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)

# Classes of which a table of all pairs is made without being asked for by name.
MAX_CLASSES = 1000


def confusion_columns(threshold: Column | float, label: str = "label", score: str = "score") -> list[Column]:
    called, y = finite_score(score) >= threshold, binary_label(label)
    return [
        F.count_if(~called & (y == 0)).alias("tn"),
        F.count_if(called & (y == 0)).alias("fp"),
        F.count_if(~called & (y == 1)).alias("fn"),
        F.count_if(called & (y == 1)).alias("tp"),
    ]


def confusion_at(df: DataFrame, threshold: float, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(*confusion_columns(threshold, label, score))


def rates() -> dict[str, Column]:
    """Rates from tn, fp, fn, tp; 0 where undefined.

    Balanced accuracy averages recall over the classes present.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    present = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": precision,
        "recall": recall,
        "sensitivity": recall,
        "specificity": specificity,
        "f1": ratio(2 * precision * recall, precision + recall),
        "balanced_accuracy": ratio(recall + specificity, present),
    }


def with_rates(counts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    every = rates()
    return counts.select("*", *[every[n].alias(n) for n in (names or every)])


def classification_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Threshold metrics, AUC and AP per group out of one score histogram."""
    ranks = score_ranks(df, label, score, groups)
    called = F.col("score") >= threshold
    counts = ranks.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(~called, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(called, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~called, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(called, F.col("pos"))), F.lit(0)).alias("tp"),
        auc_column().alias("auc"),
        average_precision_column().alias("average_precision"),
    )
    return with_rates(counts).withColumn("threshold", F.lit(float(threshold)))


def accuracy(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions; a missing class fails the job."""
    right = present_class(truth) == present_class(predicted)
    return df.groupBy(*groups).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes; a missing class fails the job."""
    right = present_class(truth) == present_class(predicted)
    recall = df.groupBy(*groups, truth).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("class_recall"))
    return recall.groupBy(*groups).agg(F.avg("class_recall").alias("balanced_accuracy"))


def class_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``true_label, predicted_label, n`` of the pairs that occur; a missing class fails the job."""
    names = [present_class(c).cast("string").alias(a) for c, a in ((truth, "true_label"), (predicted, "predicted_label"))]
    return df.groupBy(*names).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Counts per (true_label, predicted_label), zeros included.

    With an explicit label list other pairs are dropped; the list gives order.
    """
    pairs = class_pairs(df, truth, predicted)
    if labels is None:
        # The label set is the class list: as long as the number of classes.
        seen = pairs.select(F.explode(F.array("true_label", "predicted_label")).alias("l")).distinct()
        labels = [r["l"] for r in seen.orderBy("l").limit(MAX_CLASSES + 1).collect()]
        if len(labels) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes; name the labels to tabulate, or use class_pairs")
    if len(set(labels)) != len(labels) or not labels:
        raise ValueError("labels must be unique and at least one")
    grid = df.sparkSession.createDataFrame(
        [(i, j, a, b) for i, a in enumerate(labels) for j, b in enumerate(labels)],
        "true_at int, predicted_at int, true_label string, predicted_label string",
    )
    return grid.join(pairs, ["true_label", "predicted_label"], "left").select(
        "true_at", "predicted_at", "true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_sides(truth: Column, predicted: Column, n: Column, right: Column, none: Column) -> Column:
    """A prediction seen from its true and from its predicted class."""

    def side(label, support, called, tp):
        return F.struct(label.alias("label"), support.alias("support"), called.alias("called"), tp.alias("tp"))

    return F.array(side(truth, n, none, right), side(predicted, none, n, none))


def per_class_prf(matrix: DataFrame) -> DataFrame:
    """Support, precision, recall, f1 per class from ``class_pairs`` (or ``confusion_matrix``) rows."""
    none = F.lit(0).cast("bigint")
    right = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(none)
    sides = matrix.select(F.inline(class_sides(F.col("true_label"), F.col("predicted_label"), F.col("n"), right, none))).groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return sides.select(
        "label", "support", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def macro_weighted_f1(prf: DataFrame) -> DataFrame:
    return prf.agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[tuple[str, float]], label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Metrics per named threshold, counted on the distinct-score histogram.

    The thresholds sit in the plan; each task returns one row per threshold.
    """
    return histogram_sweep(score_histogram(df, label, score, groups), thresholds, groups)


def histogram_sweep(hist: DataFrame, thresholds: Sequence[tuple[str, float]], groups: Sequence[str] = ()) -> DataFrame:
    """``threshold_sweep`` of rows of ``score_histogram``."""
    cells = F.array(*[F.struct(F.lit(n).alias("threshold_name"), F.lit(float(t)).alias("threshold")) for n, t in thresholds])
    counts = (
        hist.select(*groups, "score", "pos", "neg", F.inline(cells))
        .groupBy(*groups, "threshold_name", "threshold")
        .agg(
            F.sum(F.when(F.col("score") < F.col("threshold"), F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("score") < F.col("threshold"), F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("pos")).otherwise(0)).alias("tp"),
        )
    )
    return with_rates(counts)


def youden_threshold(df: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return with_rates(youden_counts(score_ranks(df, label, score, groups), groups))


def preset_sweep(df: DataFrame, preset: str, label: str = "label", score: str = "score") -> DataFrame:
    """The named thresholds of a cohort, with its own Youden cutoff among them."""
    fixed = [(n, t) for n, t in PRESETS[preset] if t is not None]
    best = youden_threshold(df, label, score).withColumn("threshold_name", F.lit("youden_j"))
    columns = ["threshold_name", "threshold", "accuracy", "f1", "precision", "recall", "tn", "fp", "fn", "tp"]
    return threshold_sweep(df, fixed, label, score).select(*columns).unionByName(best.select(*columns))


def fpr_sweep(df: DataFrame, score: str = "score", thresholds: Sequence[float] = ALL_NORMAL_THRESHOLDS) -> DataFrame:
    """Calls and false-positive rate per threshold in an all-normal cohort."""
    counts = df.select(finite_score(score).alias("s")).agg(F.count("*").alias("n"), *[F.count_if(F.col("s") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("tumor_calls"), F.col("n").alias("n")) for i, t in enumerate(thresholds)])
    return counts.select(F.inline(rows)).select(
        "threshold", "tumor_calls", (F.col("n") - F.col("tumor_calls")).alias("normal_calls"),
        F.try_divide(F.col("tumor_calls").cast("double"), F.col("n").cast("double")).alias("false_positive_rate"),
    )


def false_positive_rate(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """fp / (fp + tn); null without negatives."""
    return confusion_at(df, threshold, label, score, groups).select(
        *groups, "fp", "tn", F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")).alias("fpr")
    )


def labelled_summary(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return classification_metrics(df, threshold, label, score, groups).select(
        *groups,
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("n_tumor"),
        (F.col("tn") + F.col("fp")).alias("n_normal"),
        "auc", "average_precision", "accuracy", "f1", "precision", "recall", "tn", "fp", "fn", "tp", "threshold",
    )


def all_normal_summary(df: DataFrame, threshold: float = 0.5, score: str = "tumor_probability", groups: Sequence[str] = ()) -> DataFrame:
    """Calls, false-positive rate and upper quantiles from one histogram."""
    groups = list(groups)
    hist = df.groupBy(*groups, finite_score(score).alias("v")).agg(F.count("*").alias("m"))
    probs = (0.5, 0.9, 0.95, 1.0)
    ranked = running_sums(hist, groups, "v", ["m"])
    called = F.coalesce(F.sum(F.when(F.col("v") >= threshold, F.col("m"))), F.lit(0))
    s = ranked.groupBy(*groups).agg(
        F.sum("m").alias("n"), called.alias("tumor_calls"), *rank_values(probs)
    ).withColumn("q", interpolate(probs, F.col("n")))
    return s.select(
        *groups,
        "n",
        F.lit(float(threshold)).alias("threshold"),
        "tumor_calls",
        (F.col("n") - F.col("tumor_calls")).alias("normal_calls"),
        (F.col("tumor_calls").cast("double") / F.col("n").cast("double")).alias("false_positive_rate"),
        *[F.get("q", F.lit(i)).alias(f"{name}_tumor_probability") for i, name in enumerate(("median", "p90", "p95", "max"))],
    )


def by_site_summary(df: DataFrame, site: str = "primary_site", threshold: float = 0.5) -> DataFrame:
    """Per site, worst false-positive rate first, then highest score."""
    return all_normal_summary(df, threshold, groups=[site]).select(
        site, "n", "tumor_calls", "false_positive_rate", "median_tumor_probability", "max_tumor_probability"
    ).orderBy(F.desc("false_positive_rate"), F.desc("max_tumor_probability"), site)


def by_sample_type_summary(df: DataFrame, sample_type: str = "sample_type", score: str = "tumor_probability", threshold: float = 0.5) -> DataFrame:
    means = df.groupBy(sample_type).agg(F.avg(score).alias("mean_tumor_probability"))
    rest = all_normal_summary(df, threshold, score, [sample_type])
    return rest.join(means, sample_type).select(
        sample_type, "n", "mean_tumor_probability", "median_tumor_probability", "tumor_calls"
    )


def score_quantiles(df: DataFrame, group: str = "sample_type", score: str = "tumor_probability", probs: Sequence[float] = TYPE_QUANTILES) -> DataFrame:
    """One column per quantile."""
    q = exact_quantiles(df, score, probs, [group])
    names = [f"q{str(p).replace('.', '_')}" for p in probs]
    return q.select(group, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def project_metrics(df: DataFrame, project: str = "project", label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """n, class counts, AUC and accuracy per project, in name order."""
    return labelled_summary(df, threshold, label, score, [project]).select(
        project, "n", "n_tumor", "n_normal", "auc", "accuracy"
    ).orderBy(project)


def type_metrics(predictions: DataFrame, held_out: str = "held_out_type", label: str = "label", score: str = "tumor_probability") -> DataFrame:
    return labelled_summary(predictions, 0.5, label, score, [held_out]).select(
        held_out, F.lit("logistic_regression").alias("model"), F.col("n").alias("n_test"), "n_normal", "n_tumor", "auc",
        F.col("average_precision").alias("avg_precision"), "accuracy", "f1", "precision", "recall",
    ).orderBy(held_out)


def pooled_and_macro(predictions: DataFrame, per_type: DataFrame, label: str = "label", score: str = "tumor_probability") -> DataFrame:
    """Pooled metrics over all predictions, mean and worst AUC over types."""
    pooled = labelled_summary(predictions, 0.5, label, score).select(
        F.col("auc").alias("pooled_auc"), F.col("average_precision").alias("pooled_avg_precision"),
        F.col("accuracy").alias("pooled_accuracy"), F.col("f1").alias("pooled_f1"),
        F.lit(None).cast("double").alias("auc"),
    )
    types = per_type.select(
        *[F.lit(None).cast("double").alias(c) for c in ("pooled_auc", "pooled_avg_precision", "pooled_accuracy", "pooled_f1")], "auc"
    )
    return pooled.unionByName(types).agg(
        F.lit("logistic_regression").alias("model"),
        *[F.max(c).alias(c) for c in ("pooled_auc", "pooled_avg_precision", "pooled_accuracy", "pooled_f1")],
        F.avg("auc").alias("macro_mean_auc"),
        F.min("auc").alias("macro_min_auc"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.count("*").alias("n_folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def optimal_threshold_per_type(predictions: DataFrame, held_out: str = "held_out_type", label: str = "label", score: str = "tumor_probability") -> DataFrame:
    """Accuracy at 0.5 and at each type's own Youden cutoff, from one histogram."""
    ranks = score_ranks(predictions, label, score, [held_out])
    best = with_rates(youden_counts(ranks, [held_out]), ["accuracy"]).select(
        held_out, F.col("accuracy").alias("accuracy_optimal_thresh")
    )
    right = F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    base = ranks.groupBy(held_out).agg(
        auc_column().alias("auc"),
        (F.sum(right).cast("double") / F.sum(F.col("pos") + F.col("neg")).cast("double")).alias("accuracy_default_thresh"),
    )
    return base.join(best, held_out).select(held_out, "auc", "accuracy_default_thresh", "accuracy_optimal_thresh")


def within_vs_heldout(loco: DataFrame, within: DataFrame) -> DataFrame:
    """Held-out-type results beside within-cohort results, largest drop first."""
    a = loco.select("held_out_type", "n_test", F.col("auc").alias("loco_auc"), F.col("accuracy").alias("loco_acc"), F.col("recall").alias("loco_recall"))
    b = within.select(F.col("project").alias("held_out_type"), F.col("n").alias("within_n"), F.col("auc").alias("within_auc"), F.col("accuracy").alias("within_acc"))
    return a.join(b, "held_out_type").withColumn("auc_drop", F.col("within_auc") - F.col("loco_auc")).orderBy(F.desc("auc_drop"), "held_out_type")


def compare_metric_tables(left: DataFrame, right: DataFrame, key: str, identity: Sequence[str], numeric: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per metric: rows on one side only, identity changes, largest delta."""
    j = left.alias("a").join(right.alias("b"), key, "full_outer")
    one_sided = F.count_if(F.col(f"a.{identity[0]}").isNull() | F.col(f"b.{identity[0]}").isNull())
    changed = F.lit(False)
    for c in identity:
        changed = changed | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    agg = j.agg(
        one_sided.alias("unmatched"), F.count_if(changed).alias("changed"),
        *[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(f"d_{c}") for c in numeric],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col("unmatched"), F.col("changed"), F.col(f"d_{c}").alias("max_abs_delta")) for c in numeric])
    return agg.select(F.inline(rows)).withColumn(
        "within_tolerance",
        (F.col("unmatched") == 0) & (F.col("changed") == 0) & (F.coalesce("max_abs_delta", F.lit(0.0)) <= tolerance),
    )
