"""Input quality report: value ranges, distribution shift, scores, 15 rules.

Missing genes count as non-finite here, unlike in the scoring guards. All
per-sample figures are row-local; cohort figures are aggregates. Nothing that
grows with the cohort reaches the driver: a report is a fixed set of numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import check_fraction, quantile_name, sigmoid, sorted_quantile
from ..session import materialize
from ..sources.matrix import ExpressionMatrix
from .align import Aligned, align
from .model import LinearModel
from .ranking import exact_cell_quantiles, exact_quantiles
from .score import logits, standardize

# Default rule limits.
RULES = {
    "min_match_rate_fail": 0.50,
    "min_match_rate_warn": 0.95,
    "negative_fraction_warn": 0.001,
    "value_p99_warn_above": 12.0,
    "value_p99_fail_above": 20.0,
    "value_max_warn_above": 30.0,
    "value_max_fail_above": 100.0,
    "nonfinite_fraction_warn": 0.0,
    "abs_z_gt_6_fraction_warn": 0.005,
    "abs_z_gt_10_fraction_warn": 0.001,
    "gene_mean_abs_z_p99_warn": 3.0,
    "gene_mean_abs_z_max_warn": 8.0,
    "expected_class_warn_fraction": 0.20,
}
# Quantiles of the report.
VALUE_PROBS = (0, 0.01, 0.50, 0.99, 1)
SHIFT_PROBS = (0.50, 0.90, 0.95, 0.99, 1)
SCORE_PROBS = (0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 1)
COHORT_RULE_SAMPLES = 20


def check_rules(supplied: dict | None) -> dict:
    """Rule limits with overrides; unknown, non-finite or crossed limits are errors."""
    rules = dict(RULES)
    unknown = sorted(set(supplied or {}) - set(RULES))
    if unknown:
        raise ValueError("unknown QC rules: " + ", ".join(unknown))
    for name, value in (supplied or {}).items():
        number = float(value)
        if not math.isfinite(number) or number < 0 or (("fraction" in name or "match_rate" in name) and number > 1):
            raise ValueError(f"QC rule {name} is out of range: {value!r}")
        rules[name] = number
    for low, high in (("min_match_rate_fail", "min_match_rate_warn"), ("value_p99_warn_above", "value_p99_fail_above"), ("value_max_warn_above", "value_max_fail_above")):
        if rules[low] > rules[high]:
            raise ValueError(f"QC rule {low} must not exceed {high}")
    return rules


def sample_stats(a: Aligned) -> DataFrame:
    """Per sample: invalid cells, median and p95 of |z|, extremes, score. Row-local."""
    keep = [c for c in a.rows.columns if c != "x"]
    z = a.rows.select(*keep, "x", standardize(F.col("x"), a.model).alias("z"))
    abs_z = z.select(*keep, "x", "z", F.sort_array(F.transform("z", lambda v: F.abs(v))).alias("abs_z"), logits("z", a.model).alias("logit"))
    return abs_z.select(
        *keep,
        "x",
        "z",
        F.size(F.filter("x", lambda v: v.isNotNull())).alias("n_finite"),
        F.size(F.filter("x", lambda v: v < -1e-9)).alias("n_negative"),
        sorted_quantile(F.col("abs_z"), 0.5).alias("median_abs_z"),
        sorted_quantile(F.col("abs_z"), 0.95).alias("p95_abs_z"),
        F.size(F.filter("abs_z", lambda v: v > 6)).alias("n_gt_6"),
        F.size(F.filter("abs_z", lambda v: v > 10)).alias("n_gt_10"),
        sigmoid("logit").alias("tumor_probability"),
    )


def cell_totals(stats: DataFrame, n_genes: int, threshold: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """One pass over samples: sizes, shares and score counts."""
    cells = F.count("*") * n_genes
    share = lambda c: F.try_divide(F.sum(c).cast("double"), cells.cast("double"))
    called = F.count_if(F.col("tumor_probability") >= threshold)
    return stats.groupBy(*groups).agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum("n_finite"), F.lit(0)).alias("finite_model_gene_values"),
        (1.0 - F.coalesce(share("n_finite"), F.lit(0.0))).alias("nonfinite_or_missing_fraction"),
        F.try_divide(F.sum("n_negative").cast("double"), F.sum("n_finite").cast("double")).alias("negative_fraction"),
        share("n_gt_6").alias("abs_z_gt_6_fraction"),
        share("n_gt_10").alias("abs_z_gt_10_fraction"),
        called.alias("tumor_calls"),
        (F.count("*") - called).alias("normal_calls"),
        F.try_divide(called.cast("double"), F.count("*").cast("double")).alias("tumor_call_fraction"),
        F.avg(F.when(F.col("tumor_probability") >= 0.99, 1.0).otherwise(0.0)).alias("probability_ge_0_99_fraction"),
        F.avg(F.when(F.col("tumor_probability") <= 0.01, 1.0).otherwise(0.0)).alias("probability_le_0_01_fraction"),
    )


def named_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """min / pNN / max columns over finite values."""
    q = exact_quantiles(df, value, probs, groups)
    return q.select(*groups, *[F.get("q", F.lit(i)).alias(quantile_name(p)) for i, p in enumerate(probs)])


def sample_shift(stats: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Quantiles over samples of the three per-sample figures, in one histogram."""
    stacked = stats.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("figure"), F.col(c).alias("value"))
                    for n, c in (("sample_median_abs_z", "median_abs_z"), ("sample_p95_abs_z", "p95_abs_z"), ("tumor_probability", "tumor_probability"))
                ]
            )
        ),
    )
    return exact_quantiles(stacked, "value", sorted(set(SHIFT_PROBS + SCORE_PROBS)), [*groups, "figure"])


def gene_shift(a: Aligned, groups: Sequence[str] = ()) -> DataFrame:
    """|mean z| per model gene."""
    cells = a.rows.select(*groups, F.posexplode(standardize(F.col("x"), a.model)).alias("pos", "z"))
    return cells.groupBy(*groups, "pos").agg(F.abs(F.avg("z")).alias("gene_mean_abs_z"))


def gene_shift_quantiles(a: Aligned, groups: Sequence[str] = ()) -> DataFrame:
    """Over genes: at most one value per model gene and group, so plain percentile."""
    q = gene_shift(a, groups).groupBy(*groups).agg(F.percentile("gene_mean_abs_z", list(map(float, SHIFT_PROBS))).alias("q"))
    return q.select(*groups, *[F.get("q", F.lit(i)).alias(quantile_name(p)) for i, p in enumerate(SHIFT_PROBS)])


def finite_cells(a: Aligned) -> DataFrame:
    return a.rows.select(F.explode(F.filter("x", lambda v: v.isNotNull())).alias("value"))


def _messages(match: tuple[int, int], t: dict, values: dict, gene: dict, rules: dict, expected: str) -> list[dict]:
    """Rules in report order: (level, code, condition, value)."""
    matched, total = match
    rate = matched / total if total else 0.0
    p99, top = values["p99"], values["max"]
    out = []

    def add(level, code, value):
        out.append({"level": level, "code": code, "message": f"{code.replace('_', ' ')}: {value:.6g}"})

    def ladder(value, error_limit, error_code, warn_limit, warn_code):
        if value is not None and value > error_limit:
            add("ERROR", error_code, value)
        elif value is not None and value > warn_limit:
            add("WARNING", warn_code, value)

    def warn(value, limit, code):
        if value is not None and value > limit:
            add("WARNING", code, value)

    if matched == 0:
        add("ERROR", "no_model_genes_matched", 0)
    elif rate < rules["min_match_rate_fail"]:
        add("ERROR", "very_low_model_gene_match", rate)
    elif rate < rules["min_match_rate_warn"]:
        add("WARNING", "low_model_gene_match", rate)
    warn(t["nonfinite_or_missing_fraction"], rules["nonfinite_fraction_warn"], "nonfinite_or_missing_values")
    warn(t["negative_fraction"], rules["negative_fraction_warn"], "negative_expression_values")
    ladder(p99, rules["value_p99_fail_above"], "expression_values_too_large", rules["value_p99_warn_above"], "expression_values_high")
    ladder(top, rules["value_max_fail_above"], "expression_max_too_large", rules["value_max_warn_above"], "expression_max_high")
    warn(t["abs_z_gt_6_fraction"], rules["abs_z_gt_6_fraction_warn"], "many_extreme_standardized_values")
    warn(t["abs_z_gt_10_fraction"], rules["abs_z_gt_10_fraction_warn"], "very_extreme_standardized_values")
    if t["samples"] >= COHORT_RULE_SAMPLES:
        warn(gene["p99"], rules["gene_mean_abs_z_p99_warn"], "cohort_distribution_shift")
        warn(gene["max"], rules["gene_mean_abs_z_max_warn"], "large_cohort_gene_shift")
    called = t["tumor_call_fraction"]
    if expected == "normal":
        warn(called, rules["expected_class_warn_fraction"], "unexpected_tumor_calls")
    if expected == "tumor":
        warn(None if called is None else 1.0 - called, rules["expected_class_warn_fraction"], "unexpected_normal_calls")
    return out


def inspect(
    model: LinearModel,
    matrix: ExpressionMatrix,
    threshold: float = 0.5,
    expected_class: str = "unknown",
    rules: dict | None = None,
    reference_source: str = "built-in heuristic rules",
) -> dict:
    """The whole report as a dictionary with fixed keys."""
    threshold = check_fraction(threshold)
    return inspect_aligned(align(matrix, model), len(matrix.genes), threshold, expected_class, rules, reference_source)


def inspect_aligned(a: Aligned, n_input_genes: int, threshold: float = 0.5, expected_class: str = "unknown", rules: dict | None = None, reference_source: str = "built-in heuristic rules") -> dict:
    limits = check_rules(rules)
    n_genes = len(a.positions)
    # A few numbers per sample instead of its cells, for the two tables below.
    stats = materialize(sample_stats(a).drop("x", "z"), "sample-figures")
    t = cell_totals(stats, n_genes, threshold).head().asDict()
    _, cell_q = exact_cell_quantiles(finite_cells(a), "value", VALUE_PROBS)
    values = {quantile_name(p): v for p, v in zip(VALUE_PROBS, cell_q)}
    probs = sorted(set(SHIFT_PROBS + SCORE_PROBS))
    shift = {r["figure"]: dict(zip(probs, r["q"])) for r in sample_shift(stats).collect()}
    gene_row = gene_shift_quantiles(a).head()
    gene = {quantile_name(p): (gene_row[quantile_name(p)] if gene_row else None) for p in SHIFT_PROBS}
    messages = _messages((a.n_matched, n_genes), t, values, gene, limits, expected_class)
    levels = {m["level"] for m in messages}

    def pick(figure, wanted):
        return {quantile_name(p): shift.get(figure, {}).get(p) for p in wanted}

    return {
        "status": "FAIL" if "ERROR" in levels else "WARN" if levels else "PASS",
        "threshold": threshold,
        "expected_class": expected_class,
        "reference_source": reference_source,
        "shape": {"samples": t["samples"], "input_genes": n_input_genes, "model_genes": n_genes},
        "gene_match": {
            "matched_model_genes": a.n_matched,
            "missing_model_genes": n_genes - a.n_matched,
            "match_rate": a.n_matched / n_genes,
            "first_missing_model_genes": [g for g, p in zip(a.model.genes, a.positions) if p < 0][:20],
        },
        "value_summary": {
            "finite_model_gene_values": t["finite_model_gene_values"],
            "nonfinite_or_missing_fraction": t["nonfinite_or_missing_fraction"],
            "negative_fraction": t["negative_fraction"],
            **values,
        },
        "distribution_summary": {
            "sample_median_abs_z": pick("sample_median_abs_z", SHIFT_PROBS),
            "sample_p95_abs_z": pick("sample_p95_abs_z", SHIFT_PROBS),
            "cohort_gene_mean_abs_z": gene,
            "abs_z_gt_6_fraction": t["abs_z_gt_6_fraction"],
            "abs_z_gt_10_fraction": t["abs_z_gt_10_fraction"],
        },
        "score_summary": {
            "tumor_calls": t["tumor_calls"],
            "normal_calls": t["normal_calls"],
            "tumor_call_fraction": t["tumor_call_fraction"],
            "tumor_probability": pick("tumor_probability", SCORE_PROBS),
            "probability_ge_0_99_fraction": t["probability_ge_0_99_fraction"],
            "probability_le_0_01_fraction": t["probability_le_0_01_fraction"],
        },
        "messages": messages,
    }


REPORT_SCHEMA = (
    "cohort string, status string, samples bigint, matched_model_genes int, match_rate double, finite_model_gene_values bigint, "
    "nonfinite_or_missing_fraction double, negative_fraction double, value_p50 double, value_p99 double, value_max double, "
    "sample_median_abs_z_p50 double, sample_p95_abs_z_p50 double, gene_mean_abs_z_p99 double, gene_mean_abs_z_max double, "
    "abs_z_gt_6_fraction double, abs_z_gt_10_fraction double, tumor_calls bigint, normal_calls bigint, "
    "tumor_probability_p50 double, message_codes string, report_json string"
)


def report_frame(spark: SparkSession, reports: dict[str, dict]) -> DataFrame:
    """Reports as rows: headline numbers and the full JSON."""
    rows = []
    for cohort, r in reports.items():
        v, d, s = r["value_summary"], r["distribution_summary"], r["score_summary"]
        rows.append(
            (
                cohort, r["status"], r["shape"]["samples"], r["gene_match"]["matched_model_genes"], r["gene_match"]["match_rate"],
                v["finite_model_gene_values"], v["nonfinite_or_missing_fraction"], v["negative_fraction"], v["p50"], v["p99"], v["max"],
                d["sample_median_abs_z"]["p50"], d["sample_p95_abs_z"]["p50"], d["cohort_gene_mean_abs_z"]["p99"], d["cohort_gene_mean_abs_z"]["max"],
                d["abs_z_gt_6_fraction"], d["abs_z_gt_10_fraction"], s["tumor_calls"], s["normal_calls"], s["tumor_probability"]["p50"],
                ",".join(m["code"] for m in r["messages"]), json.dumps(r, allow_nan=False),
            )
        )
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def qc_reference(spark: SparkSession, model: LinearModel, cohorts: dict[str, ExpressionMatrix], combine: Sequence[str] = ()) -> DataFrame:
    """Report per cohort, and on the union of the named compatible cohorts."""
    from .cohort import union_cohorts

    every = dict(cohorts)
    if combine:
        every["compatible_combined"] = union_cohorts([cohorts[c] for c in combine])
    return report_frame(spark, {name: inspect(model, m) for name, m in every.items()})


def value_summary(a: Aligned) -> DataFrame:
    """Counts, shares and quantiles of all model-gene cells, one row."""
    n_genes = len(a.positions)
    cells = a.rows.select(
        F.size(F.filter("x", lambda v: v.isNotNull())).alias("n_finite"), F.size(F.filter("x", lambda v: v < -1e-9)).alias("n_negative")
    ).agg(
        F.sum("n_finite").alias("finite_values"),
        (1.0 - F.sum("n_finite") / (F.count("*") * n_genes)).alias("nonfinite_fraction"),
        F.try_divide(F.sum("n_negative").cast("double"), F.sum("n_finite").cast("double")).alias("negative_fraction"),
    )
    _, q = exact_cell_quantiles(finite_cells(a), "value", VALUE_PROBS)
    return cells.select("*", *[F.lit(v).cast("double").alias(quantile_name(p)) for p, v in zip(VALUE_PROBS, q)])

