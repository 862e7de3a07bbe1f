"""Exact ranking statistics over any number of rows.

Nothing here sorts a whole group in one task. Rows collapse to a histogram of
distinct values first, so ties and hot values cost one row. The histogram is cut
into value ranges of about ``ROWS_PER_RANGE`` rows; running sums are taken inside
each range and shifted by the totals of the ranges before it. The cut points are
a bounded list on the driver and literals in the plan, so every evaluation, also
after a lost executor, sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import draw_key
from ..functions.numeric import as_number, double_array, finite_or_null, is_finite
from ..session import materialize

ROWS_PER_RANGE = 500_000
SMALL_BYTES = 32 << 20
MAX_RANGES = 4096
HASH_DIGITS = 3


def _planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; it costs no job. Unknown counts as large."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except (AttributeError, ValueError):
        return 1 << 62


def _range_bounds(hist: DataFrame, value: str, rows_per_range: int) -> list[float]:
    ranges = min(MAX_RANGES, -(-hist.count() // rows_per_range))
    if ranges <= 1:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    bounds = hist.agg(F.percentile_approx(value, probs, 10 * ranges)).head()[0]
    return sorted(set(bounds))


def running_sums(hist: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values) and ``<m>_total`` per group.

    ``hist`` has one row per (groups, value).
    """
    groups = list(groups)
    bounds = []
    if rows_per_range != ROWS_PER_RANGE or _planned_bytes(hist) > SMALL_BYTES:
        # Computed once into the shared folder, then counted and cut from there.
        hist = materialize(hist, "histogram")
        bounds = _range_bounds(hist, value, rows_per_range)
    if not bounds:
        part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
        before = part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return hist.select(
            "*",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(part).alias(f"{m}_total") for m in measures],
        )
    cut = double_array(bounds)
    ranged = hist.withColumn("range_id", F.size(F.filter(cut, lambda b: b < F.col(value))))
    totals = ranged.groupBy(*groups, "range_id").agg(*[F.sum(m).alias(f"{m}_sum") for m in measures])
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = part.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "range_id",
        *[F.coalesce(F.sum(f"{m}_sum").over(before), F.lit(0)).alias(f"{m}_offset") for m in measures],
        *[F.sum(f"{m}_sum").over(part).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*groups, "range_id").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, [*groups, "range_id"])
        .select(
            *hist.columns,
            *[(F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"{m}_offset")).alias(f"{m}_before") for m in measures],
            *[f"{m}_total" for m in measures],
        )
    )


def binary_label(label: str) -> Column:
    """The label as 0 or 1; a row with another value, null included, fails the job."""
    y = as_number(label)
    return F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(F.raise_error(F.lit(f"{label} must hold only the labels 0 and 1")))


def finite_score(score: str) -> Column:
    """The score as a number; a row where it is missing or not finite fails the job."""
    s = as_number(score)
    return F.when(is_finite(s), s).otherwise(F.raise_error(F.lit(f"{score} must hold only finite numbers")))


def present_class(c: str) -> Column:
    """A class name; a row without one fails the job."""
    missing = F.col(c).isNull() | F.coalesce(F.col(c).cast("string") == "NaN", F.lit(False))
    return F.when(~missing, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must not be missing")))


def score_histogram(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: ``score, pos, neg``.

    Labels other than 0 and 1 and scores that are no finite numbers are refused
    in the same pass.
    """
    rows = df.select(*groups, binary_label(label).alias("label"), finite_score(score).alias("score"))
    return rows.groupBy(*groups, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def score_ranks(df: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Histogram with counts below each score and group totals."""
    return running_sums(score_histogram(df, label, score, groups), groups, "score", ["pos", "neg"])


def _double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def auc_column() -> Column:
    """Mann-Whitney with mid-ranks over ``score_ranks`` rows; null for one class."""
    wins = F.sum(_double("pos") * (_double("neg_before") + _double("neg") / 2.0))
    return F.try_divide(wins, F.max(_double("pos_total") * _double("neg_total")))


def average_precision_column() -> Column:
    """Each distinct score is one threshold; null without positives."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return F.sum(F.try_divide(_double("pos"), _double("pos_total")) * F.try_divide(_double(tp), _double(tp + fp)))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``average_precision`` per group from one histogram."""
    return score_ranks(df, label, score, groups).groupBy(*groups).agg(
        auc_column().alias("auc"), average_precision_column().alias("average_precision")
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return score_ranks(df, label, score, groups).groupBy(*groups).agg(auc_column().alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return score_ranks(df, label, score, groups).groupBy(*groups).agg(
        average_precision_column().alias("average_precision")
    )


def youden_counts(ranks: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Best cutoff per group with its confusion counts.

    Candidates are the distinct scores, 0 and 1; the greatest (J, accuracy,
    -threshold) wins. A group without both classes, or with a score that is no
    probability, fails the job.
    """
    two = (F.col("pos_total") > 0) & (F.col("neg_total") > 0)
    refused = F.when(~two, F.lit("a cutoff needs both classes")).when(~F.col("score").between(0, 1), F.lit("scores must be probabilities from 0 to 1"))
    ranks = ranks.withColumn("score", F.when(refused.isNull(), F.col("score")).otherwise(F.raise_error(refused)))
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    observed = F.struct(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"))
    all_called = F.struct(F.lit(0.0).alias("threshold"), F.col("pos_total").alias("tp"), F.col("neg_total").alias("fp"))
    at_one = F.struct(F.lit(1.0).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    # Only the first row of a group needs to bring the two boundary candidates,
    # but any row may: the maximum ignores repeats. A score of exactly 1 is
    # observed itself, so the empty call set is offered only below it.
    top = F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg") == F.col("pos_total") + F.col("neg_total")
    cands = F.when(
        top, F.array(observed, all_called, F.when(F.col("score") < 1.0, at_one).otherwise(all_called))
    ).otherwise(F.array(observed))
    rows = ranks.select(*groups, "pos_total", "neg_total", F.explode(cands).alias("c"))
    sensitivity = _double("c.tp") / _double("pos_total")
    specificity = _double(F.col("neg_total") - F.col("c.fp")) / _double("neg_total")
    accuracy = _double(F.col("c.tp") + F.col("neg_total") - F.col("c.fp")) / _double(F.col("pos_total") + F.col("neg_total"))
    keyed = rows.select(
        *groups,
        F.struct(
            (sensitivity + specificity - 1.0).alias("youden_j"), accuracy.alias("accuracy"), (-F.col("c.threshold")).alias("neg_threshold"),
            F.col("c.tp").alias("tp"), F.col("c.fp").alias("fp"), "pos_total", "neg_total",
        ).alias("k"),
    )
    return keyed.groupBy(*groups).agg(F.max("k").alias("k")).where("k is not null").select(
        *groups,
        (-F.col("k.neg_threshold")).alias("threshold"),
        (F.col("k.neg_total") - F.col("k.fp")).alias("tn"),
        F.col("k.fp").alias("fp"),
        (F.col("k.pos_total") - F.col("k.tp")).alias("fn"),
        F.col("k.tp").alias("tp"),
        F.col("k.youden_j").alias("youden_j"),
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of finite values: ``groups, n, q array``.

    Works from the distinct-value histogram, so a group may hold any share of
    the rows.
    """
    groups = list(groups)
    hist = (
        df.select(*groups, finite_or_null(value).alias("v"))
        .where("v is not null")
        .groupBy(*groups, "v")
        .agg(F.count("*").alias("m"))
    )
    ranked = running_sums(hist, groups, "v", ["m"])
    return ranked.groupBy(*groups).agg(F.max("m_total").alias("n"), *rank_values(probs)).select(
        *groups, "n", interpolate(probs, F.col("n")).alias("q")
    )


def rank_values(probs: Sequence[float]) -> list[Column]:
    """Values at the two ranks around each quantile, over ``running_sums`` rows (v, m)."""
    out = []
    below = F.col("m_before")
    for i, p in enumerate(probs):
        at = (F.col("m_total") - 1).cast("double") * F.lit(float(p))
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            out.append(F.max(F.when((below <= rank) & (rank < below + F.col("m")), F.col("v"))).alias(f"{name}{i}"))
    return out


def interpolate(probs: Sequence[float], n: Column) -> Column:
    values = []
    for i, p in enumerate(probs):
        at = (n - 1).cast("double") * F.lit(float(p))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        values.append(lo + (hi - lo) * (at - F.floor(at)))
    return F.array(*values)


def exact_cell_quantiles(values: DataFrame, value: str, probs: Sequence[float], accuracy: int = 10_000) -> tuple[int, list[float | None]]:
    """Quantiles of a very long column (every cell of a matrix), driver result.

    A first pass sketches a bracket around each quantile (its rank error is
    bounded by n/accuracy), a second pass counts what lies below each bracket and
    keeps a histogram of only what lies inside. Exact, with no sort of the whole
    column. Values must be finite.
    """
    inner = [p for p in probs if 0 < p < 1]
    spread = 3.0 / accuracy
    wanted = [q for p in inner for q in (max(0.0, p - spread), min(1.0, p + spread))]
    first = values.agg(
        F.count(value).alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.percentile_approx(value, wanted or [0.5], accuracy).alias("b"),
    ).head()
    n = first["n"]
    if not n:
        return 0, [None] * len(probs)
    result = {0: first["lo"], 1: first["hi"]}
    if inner and n * spread < 4:
        # Fewer rows than a bracket needs, some 13,000 at most by default.
        exact = values.agg(F.percentile(value, list(map(float, inner)))).head()[0]
        result.update(zip(inner, exact))
    elif inner:
        brackets = [(first["b"][2 * i], first["b"][2 * i + 1]) for i in range(len(inner))]
        v = F.col(value)
        slot = F.filter(
            F.array(*[F.when(v <= b, F.struct(F.lit(i).alias("slot"), F.when(v >= a, v).alias("v"))) for i, (a, b) in enumerate(brackets)]),
            lambda s: s.isNotNull(),
        )
        # Everything below a bracket collapses to one row (v null) per task.
        hist = values.select(F.inline(slot)).groupBy("slot", "v").agg(F.count("*").alias("m"))
        picked = _bracket_ranks(hist, inner, n)
        for r in picked:
            p = inner[r["slot"]]
            at = (n - 1) * p
            result[p] = r["lo"] + (r["hi"] - r["lo"]) * (at - int(at))
    return n, [result[p] for p in probs]


def _bracket_ranks(hist: DataFrame, inner: Sequence[float], n: int) -> list:
    below = hist.where("v is null").select("slot", F.col("m").alias("below"))
    ranked = running_sums(hist.where("v is not null"), ["slot"], "v", ["m"]).join(F.broadcast(below), "slot", "left")
    start = F.col("m_before") + F.coalesce("below", F.lit(0))
    at = F.lit(float(n - 1)) * F.get(double_array(inner), F.col("slot"))

    def pick(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < start + F.col("m")), F.col("v")))

    return ranked.groupBy("slot").agg(pick(F.floor(at)).alias("lo"), pick(F.ceil(at)).alias("hi")).collect()


def hash_rank(df: DataFrame, key: str, seed: int, groups: Sequence[str] = (), rank: str = "draw_rank") -> DataFrame:
    """1-based rank of each row in reproducible random order, per group.

    The leading hash digits split a group into 4,096 even slices, each ranked on
    its own and shifted by the sizes of the slices before it.
    """
    groups = list(groups)
    keyed = df.withColumn("draw_key", draw_key(seed, key)).withColumn("slice_id", F.substring("draw_key", 1, HASH_DIGITS))
    sizes = keyed.groupBy(*groups, "slice_id").agg(F.count("*").alias("slice_n"))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = part.orderBy("slice_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "slice_id", F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("slice_offset"))
    inside = Window.partitionBy(*groups, "slice_id").orderBy("draw_key", key)
    return (
        keyed.join(offsets, [*groups, "slice_id"])
        .withColumn(rank, F.row_number().over(inside) + F.col("slice_offset"))
        .select(*df.columns, "draw_key", rank)
    )
