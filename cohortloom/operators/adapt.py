"""Cohort standardisation and how it behaves under other class mixes.

Cohort modes are transductive: every score depends on the whole batch. They do
not restore calibration, and a threshold need not carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import array_sum, check_fraction, double_array, sigmoid
from ..session import materialize, small_side
from ..sources.matrix import ExpressionMatrix
from .align import Aligned, align
from .metrics import classification_metrics, with_rates
from .model import LinearModel, require_tumor_model
from .moments import gene_moments
from .ranking import auc_column, hash_rank, score_ranks
from .score import MODES, CohortStats, binary_scores, guard, linear_terms, score_aligned, standardize

MIN_SAMPLES = 20


def unit_if_zero(c: str):
    return F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))


def cohort_gene_stats(a: Aligned, groups: Sequence[str] = ()) -> DataFrame:
    """Per gene (and group): n, mean and population sd (0 becomes 1) of imputed values."""
    found = gene_moments(a.rows.select(*groups, a.imputed().alias("x")), groups)
    return found.select(*groups, "pos", "n", "mean", F.sqrt("var").alias("sd")).withColumn("sd", unit_if_zero("sd"))


def cohort_stats(a: Aligned) -> CohortStats:
    """The statistics on the driver: two numbers per model gene."""
    rows = sorted(cohort_gene_stats(a).collect(), key=lambda r: r["pos"])
    if not rows:
        raise ValueError("an empty cohort has no statistics")
    return CohortStats(tuple(r["mean"] for r in rows), tuple(r["sd"] for r in rows))


def cohort_adapt_score(
    model: LinearModel,
    matrix: ExpressionMatrix,
    mode: str = "none",
    threshold: float = 0.5,
    min_samples: int = MIN_SAMPLES,
    **guards,
) -> DataFrame:
    """Scores of one batch under a cohort mode; small batches are refused."""
    check_fraction(threshold)
    if mode not in MODES:
        raise ValueError(f"unknown adapt mode {mode!r}; choose from {MODES}")
    if min_samples < 2:
        raise ValueError("min_samples must be at least 2")
    a = align(matrix, require_tumor_model(model))
    if mode != "none":
        n = matrix.rows.count()
        if n < min_samples:
            raise ValueError(f"mode {mode} needs {min_samples} samples or more, got {n}")
    guard(a, **guards)
    return binary_scores(score_aligned(a, mode), threshold)


def adaptation_report(scores: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Calls, median and, where labels match both classes, rounded metrics."""
    from .calibrate import reindex_labels
    from .ranking import exact_quantiles

    calls = scores.agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("call") == "tumor").alias("tumor_calls"),
        F.count_if(F.col("call") == "normal").alias("normal_calls"),
    )
    median = exact_quantiles(scores, "tumor_probability", [0.5]).select(F.get("q", F.lit(0)).alias("median_tumor_probability"))
    parts = [calls, median]
    if labels is not None:
        joined, _ = reindex_labels(scores, labels)
        known = joined.where("label_binary is not null")
        names = ["auc", "accuracy", "balanced_accuracy", "sensitivity", "specificity"]
        parts.append(
            classification_metrics(known, threshold, "label_binary", "tumor_probability")
            .where("auc is not null")
            .select(*[F.round(n, 4).alias(n) for n in names])
        )
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def adaptation_benchmark(cohorts: dict[str, Aligned], label: str = "label", modes: Sequence[str] = MODES) -> DataFrame:
    """Cohort x mode: AUC, accuracy, balanced accuracy, false-positive rate.

    Each cohort's rows carry ``label`` (0/1). AUC and balanced accuracy are blank
    for a one-class cohort. All cohort-mode scores go through one histogram.
    """
    scored = None
    for name, a in cohorts.items():
        stats = cohort_stats(a) if any(m != "none" for m in modes) else None
        for mode in modes:
            part = score_aligned(a, mode, stats).select(
                F.lit(name).alias("cohort"), F.lit(mode).alias("mode"), label, F.col("probability").alias("score")
            )
            scored = part if scored is None else scored.unionByName(part)
    m = classification_metrics(scored, 0.5, label, "score", ["cohort", "mode"])
    two = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    fpr = F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
    return m.select(
        "cohort",
        "mode",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        F.when(two, F.round("auc", 4)).alias("auc"),
        F.round("accuracy", 4).alias("accuracy"),
        F.when(two, F.round("balanced_accuracy", 4)).alias("balanced_accuracy"),
        F.round(fpr, 4).alias("fpr"),
    )


def draw_plan(spark, fractions: Sequence[float], reps: int, n: int) -> DataFrame:
    """One row per (fraction, rep, draw) with the class to draw from."""
    k = spark.range(len(fractions) * reps * n)
    f = F.get(double_array(fractions), (F.col("id") / (reps * n)).cast("int"))
    draw = F.col("id") % n
    tumors = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.bround(f * n, 0).cast("int")))
    return k.select(
        f.alias("fraction"), ((F.col("id") / n).cast("long") % reps).alias("rep"), draw.alias("draw"),
        F.when(draw < tumors, 1).otherwise(0).alias("label"),
    )


def composition_bootstrap(
    a: Aligned,
    label: str = "label",
    fractions: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90),
    reps: int = 200,
    n: int = 80,
    seed: int = 0,
) -> DataFrame:
    """Balanced accuracy deployed and adapted, by tumor fraction of the batch.

    Batches are drawn with replacement. The md5 of a draw's name gives a rank in its
    class and joins that sample, so any engine can repeat the draws; class sizes are
    two numbers. Each batch's gene statistics are arrays joined back to its ``n`` rows.
    """
    spark = a.rows.sparkSession
    sizes = {r[label]: r["n"] for r in a.rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        raise ValueError("both classes are needed")
    indexed = hash_rank(a.rows.select("sample", F.col(label).alias("label")), "sample", seed, ["label"]).select(
        "label", (F.col("draw_rank") - 1).alias("at"), "sample"
    )
    size = F.when(F.col("label") == 1, F.lit(sizes[1])).otherwise(F.lit(sizes[0]))
    plan = draw_plan(spark, fractions, reps, n).withColumn(
        "at", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("fraction", "rep", "draw")])), 1, 12), 16, 10).cast("bigint") % size
    )
    batch = ["fraction", "rep"]
    # Ids are drawn first; only drawn samples' cells are fetched.
    picked = materialize(plan.join(indexed, ["label", "at"]), "draws")
    values = a.rows.select("sample", a.imputed().alias("v"))
    drawn = picked.join(values.join(small_side(picked.select("sample").distinct()), "sample", "left_semi"), "sample")
    moments = gene_moments(drawn.select(*batch, "v"), batch, "v").select(*batch, "pos", F.col("mean").alias("m"), F.sqrt("var").alias("s"))
    stats = moments.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("pos", "m", unit_if_zero("s").alias("s")))).alias("st"))
    model = a.model
    deployed = array_sum(linear_terms(standardize(F.col("v"), model), model.coef[0])) + model.intercept[0]
    z = F.zip_with("v", "st", lambda v, s: (v - s["m"]) / s["s"])
    adapted = array_sum(linear_terms(z, model.coef[0])) + model.intercept[0]
    scored = drawn.join(stats, batch).select(
        *batch, "label", sigmoid(deployed).alias("p_deployed"), sigmoid(adapted).alias("p_adapted")
    )
    stacked = scored.select(
        *batch, "label",
        F.inline(
            F.array(
                F.struct(F.lit("deployed").alias("kind"), F.col("p_deployed").alias("score")),
                F.struct(F.lit("adapted").alias("kind"), F.col("p_adapted").alias("score")),
            )
        ),
    )
    ranks = score_ranks(stacked, "label", "score", [*batch, "kind"])
    called = F.col("score") >= 0.5
    per_batch = with_rates(
        ranks.groupBy(*batch, "kind").agg(
            F.sum(F.when(~called, F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(called, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~called, F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(called, F.col("pos")).otherwise(0)).alias("tp"),
            auc_column().alias("auc"),
        ),
        ["balanced_accuracy"],
    )
    # Ten digits first: averages whose last bits follow the order of the rows must not tip a half.
    of = lambda kind, c: F.round(F.avg(F.when(F.col("kind") == kind, F.col(c))), 10)
    return (
        per_batch.groupBy("fraction")
        .agg(
            F.round(of("deployed", "balanced_accuracy"), 4).alias("balanced_acc_deployed"),
            F.round(of("adapted", "balanced_accuracy"), 4).alias("balanced_acc_adapted"),
            F.round(of("adapted", "auc"), 4).alias("auc_adapted"),
        )
        .select(F.col("fraction").alias("tumor_fraction"), F.lit(n).alias("cohort_n"), "balanced_acc_deployed", "balanced_acc_adapted", "auc_adapted")
        .orderBy("tumor_fraction")
    )
