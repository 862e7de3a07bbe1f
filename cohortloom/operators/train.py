"""Fit and evaluate the models with Spark ML on aligned feature rows.

A feature table has ``sample``, ``x`` (array<double>, no nulls) and metadata
columns. Selection and scaling are per-gene aggregates. The fits of all folds or
held-out types go together by Newton's method, one pass over the rows for a step of
all of them; models whose Hessians are too large for that (``newton.HESSIAN_BYTES``)
are fitted one by one by Spark ML's distributed L-BFGS.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import project_code
from ..functions.numeric import argmax_class, double_array, gather, string_array
from ..session import materialize
from . import newton
from .adapt import unit_if_zero
from .align import Aligned
from .checks import require
from .cohort import union_predictions
from .metrics import (
    accuracy,
    balanced_accuracy,
    class_sides,
    classification_metrics,
    confusion_matrix,
    cv_summary,
    macro_weighted_f1,
    per_class_prf,
    pooled_and_macro,
    project_metrics,
    type_metrics,
)
from .model import LinearModel
from .moments import gene_moments
from .ranking import roc_auc
from .score import binary_scores, score_aligned
from .splits import dependency_issues, grouped_stratified_folds, loco_splits, with_folds

MAX_ITER = 5000
TOLERANCE = 1e-7
PARALLEL_FITS = 4


def class_moments(rows: DataFrame, y: str = "y", parts: Sequence[str] = ()) -> DataFrame:
    """n, mean and population variance per (gene position, class), and part."""
    named = rows.select(*parts, F.col(y).cast("string").alias("y"), "x")
    return gene_moments(named, [*parts, "y"]).select(*parts, "pos", "y", "n", "mean", "var")


def merge_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of several parts as one: the training side of a fold is the sum
    of the other folds, so k folds need one pass over the cells, not k.

    At most parts x genes x classes rows for each of ``by``.
    """
    key = [*by, "pos", "y"]
    w = Window.partitionBy(*key)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    around = moments.select(*key, "n", grand.alias("grand"), (F.col("n") * (F.col("var") + (F.col("mean") - grand) ** 2)).alias("ss"))
    return around.groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("grand").alias("mean"), (F.sum("ss") / F.sum("n")).alias("var")
    )


def gene_totals(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per gene over classes: n, mean, population sd, the one-way F, class sizes.

    Sums of squares are formed around class means, so nothing cancels. F is
    infinite for a gene constant inside every class, null for a constant gene.
    """
    w = Window.partitionBy(*by, "pos")
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    sums = moments.select(*by, "pos", "y", "n", "var", (F.col("n") * (F.col("mean") - grand) ** 2).alias("ssb_c"), grand.alias("grand")).groupBy(*by, "pos").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.max("grand").alias("mean"),
        F.sum("ssb_c").alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"),
        F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("class_n"),
    )
    between, within = F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    f = F.when(within > 0, between / within).when(between > 0, F.lit(math.inf))
    return sums.select(*by, "pos", "n", "k", "mean", F.sqrt((F.col("ssb") + F.col("ssw")) / F.col("n")).alias("sd"), f.alias("f"), "class_n")


def anova_f(rows: DataFrame, y: str = "y") -> DataFrame:
    return gene_totals(class_moments(rows, y)).select("pos", "f")


def training_scaler(rows: DataFrame) -> DataFrame:
    """Mean and population sd per gene of the given rows; sd 0 becomes 1."""
    return gene_moments(rows).select("pos", "mean", F.sqrt("var").alias("sd")).withColumn("scale", unit_if_zero("sd")).drop("sd")


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k largest F in column order; among equals the later column, nulls last.

    One row per gene.
    """
    return scores.orderBy(F.col("f").desc_nulls_last(), F.desc("pos")).limit(k).orderBy("pos")


def class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """balanced: n / (k * n_c). One row per class."""
    counts = rows.groupBy(y).agg(F.count("*").alias("n_class"))
    w = Window.partitionBy(F.lit(0))
    return counts.select(
        y, "n_class", (F.sum("n_class").over(w) / (F.count("*").over(w) * F.col("n_class"))).alias("weight")
    )


@dataclass(frozen=True)
class Fitted:
    """Selected positions in the full gene axis plus the model over them.

    ``residual`` is the largest gradient of the objective per training row, where told.
    """

    positions: tuple[int, ...]
    model: LinearModel
    iterations: int
    residual: float | None = None

    def features(self, rows: DataFrame) -> Aligned:
        """Rows reduced to the selected genes, ready to score."""
        picked = gather("x", self.positions)
        rest = [c for c in rows.columns if c != "x"]
        n = len(self.positions)
        return Aligned(rows.select(*rest, picked.alias("x")), self.model, tuple(range(n)), self.model.genes)


@dataclass(frozen=True)
class Selection:
    """Genes, scaler and class sizes of one training side."""

    pos: list[int]
    mean: list[float]
    scale: list[float]
    counts: dict[str, int]

    @property
    def classes(self) -> list[str]:
        return sorted(self.counts)

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    def weights(self, family: str) -> dict[str, float]:
        """Balanced weights for two classes, else ones; both sum to n over the rows."""
        return {c: self.n / (len(self.counts) * m) if family == "binomial" else 1.0 for c, m in self.counts.items()}


def _select(moments: DataFrame, k: int, part: str | None, names: Sequence) -> dict:
    """The k best genes of each training side (all parts but one) in one job."""
    if part is None:
        found = {None: select_k_best(gene_totals(moments), k).collect()}
    else:
        held = F.explode(F.array(*[F.lit(n) for n in names])).alias("held")
        others = moments.select("*", held).where(F.col("held") != F.col(part)).drop(part)
        place = F.row_number().over(Window.partitionBy("held").orderBy(F.col("f").desc_nulls_last(), F.desc("pos")))
        totals = gene_totals(merge_moments(others, ["held"]), ["held"]).withColumn("place", place).where(F.col("place") <= k)
        found = {n: [] for n in names}
        for r in sorted(totals.collect(), key=lambda r: r["pos"]):
            found[r["held"]].append(r)
    return {
        n: Selection([r["pos"] for r in rows], [r["mean"] for r in rows], [r["sd"] or 1.0 for r in rows], dict(rows[0]["class_n"]) if rows else {})
        for n, rows in found.items()
    }


def _fit_alone(rows: DataFrame, chosen: Selection, y: str, c: float, family: str, max_iter: int, context: str) -> tuple[list, list, int]:
    """Spark ML's fit of one side, for models too large for joint Newton steps."""
    target = F.col(y).cast("string")
    weight = F.lit(1.0)
    for name, w in chosen.weights(family).items():
        weight = F.when(target == name, w).otherwise(weight)
    centered = F.zip_with(gather("x", chosen.pos), double_array(chosen.mean), lambda v, m: v - m)
    z = F.zip_with(centered, double_array(chosen.scale), lambda v, s: v / s)
    train = rows.select(
        (F.array_position(string_array(chosen.classes), target) - 1).cast("double").alias("label"), weight.alias("weight"), array_to_vector(z).alias("features")
    )
    # Spark ML blocks and caches the features itself. Balanced weights sum to n
    # too, so the penalty is 1/(C n) in both cases.
    lr = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * chosen.n), elasticNetParam=0.0, standardization=False, family=family, maxIter=max_iter, tol=TOLERANCE
    ).fit(train)
    if lr.summary.totalIterations >= max_iter:
        raise RuntimeError(f"{context} did not converge in {max_iter} iterations")
    return lr.coefficientMatrix.toArray().tolist(), lr.interceptVector.toArray().tolist(), lr.summary.totalIterations


def fit_sides(rows: DataFrame, y: str, genes: Sequence[str], k: int, c: float, family: str, part: str | None = None, names: Sequence = (), max_iter: int = MAX_ITER, context: str = "model") -> dict:
    """A fit for each of ``names`` on the rows of all other parts, or (no ``part``) one on all rows.

    Selection and scaling come from moments of one pass. Scaling before or after selection
    gives the same F and the same scaler, as F does not change under scaling.
    """
    if not 1 <= k <= len(genes):
        raise ValueError(f"k must be between 1 and {len(genes)}")
    if not c > 0:
        raise ValueError("C must be positive")
    moments = class_moments(rows, y, [part] if part else [])
    chosen = _select(materialize(moments, "moments") if part else moments, k, part, names)
    for name, s in chosen.items():
        if len(s.classes) < 2 or (family == "binomial" and s.classes != ["0", "1"]):
            raise ValueError(f"{context if name is None else f'{part} {name}'}: classes in the training rows are {s.classes}")
    union = sorted({p for s in chosen.values() for p in s.pos})
    labels = sorted({v for s in chosen.values() for v in s.classes})
    order = list(chosen)
    sides = [
        newton.Side(
            None if name is None else i, np.searchsorted(union, s.pos), np.array(s.mean), np.array(s.scale), np.searchsorted(labels, s.classes),
            np.array([s.weights(family)[v] for v in s.classes]), s.n, family == "binomial",
        )
        for i, (name, s) in enumerate(chosen.items())
    ]
    if newton.fits(sides):
        code = F.lit(0) if part is None else F.coalesce(F.array_position(F.array(*[F.lit(n) for n in order]), F.col(part)), F.lit(0)) - 1
        target = F.array_position(string_array(labels), F.col(y).cast("string")) - 1
        narrow = materialize(rows.select(code.cast("int").alias("part"), target.cast("int").alias("y"), gather("x", union).alias("x")), "fit-rows")
        solved = [(s.theta[:, :-1].tolist(), s.theta[:, -1].tolist(), s.passes, s.residual) for s in newton.solve(narrow, sides, c, max_iter)]
    else:
        own = lambda n: rows if n is None else rows.where(F.col(part) != n)
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            solved = list(pool.map(lambda n: (*_fit_alone(own(n), chosen[n], y, c, family, max_iter, context if n is None else f"{part} {n}"), None), order))
    found = {}
    for name, (coef, cut, passes, residual) in zip(order, solved):
        s = chosen[name]
        model = LinearModel(
            tuple(genes[p] for p in s.pos), tuple(s.mean), tuple(s.scale), tuple(map(tuple, coef)), tuple(map(float, cut)),
            ("normal", "tumor") if family == "binomial" else tuple(s.classes),
        )
        found[name] = Fitted(tuple(s.pos), model, passes, residual)
    return found


def fit_binary(rows: DataFrame, genes: Sequence[str], k: int = 2000, c: float = 0.1, y: str = "y", max_iter: int = MAX_ITER, context: str = "binary model") -> Fitted:
    """ANOVA selection, scaling, L2 logistic regression with balanced weights."""
    return fit_sides(rows, y, genes, k, c, "binomial", max_iter=max_iter, context=context)[None]


def fit_multiclass(rows: DataFrame, genes: Sequence[str], k: int = 1000, c: float = 2.0, y: str = "y", max_iter: int = MAX_ITER, context: str = "multiclass model") -> Fitted:
    return fit_sides(rows, y, genes, k, c, "multinomial", max_iter=max_iter, context=context)[None]


def optimality(fitted: Fitted, rows: DataFrame, c: float, y: str = "y") -> DataFrame:
    """``class_idx, pos, residual``: the objective's gradient per training row at the fitted model.

    ``rows`` are the training rows. The objective is strictly convex in the coefficients, so
    a gradient of zero proves the fit, however it was found. Sums come from ``gene_moments``.
    """
    m = fitted.model
    a = fitted.features(rows)
    z = F.zip_with(F.zip_with("x", double_array(m.mean), lambda v, u: v - u), double_array(m.scale), lambda v, s: v / s)
    binary = m.kind == "binary"
    target = F.col(y).cast("string")
    scored = score_aligned(Aligned(a.rows.select("sample", target.alias("t"), "x", z.alias("std")), m, a.positions, a.source_genes))
    n = rows.count()
    if binary:
        sizes = {r["t"]: r["count"] for r in scored.groupBy("t").count().collect()}  # two classes
        w = F.when(F.col("t") == "1", n / (2.0 * sizes["1"])).otherwise(n / (2.0 * sizes["0"]))
        gaps = F.array(w * (F.col("probability") - F.when(F.col("t") == "1", 1.0).otherwise(0.0)))
    else:
        gaps = F.transform(F.arrays_zip(F.col("probability").alias("p"), string_array(m.classes).alias("c")), lambda v: v["p"] - F.when(v["c"] == F.col("t"), 1.0).otherwise(0.0))
    products = F.flatten(F.transform(gaps, lambda g: F.transform("std", lambda v: v * g)))
    sums = gene_moments(scored.select(products.alias("x")))
    k = len(fitted.positions)
    pulls = double_array([b / c for row in m.coef for b in row])
    index = double_array([float(p) for p in fitted.positions])
    residual = (F.col("mean") * F.col("n") + F.get(pulls, F.col("pos"))) / n
    return sums.select(F.expr(f"pos div {k}").cast("int").alias("class_idx"), F.get(index, F.col("pos") % k).cast("int").alias("pos"), residual.alias("residual"))


def predictions(fitted: Fitted, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return binary_scores(score_aligned(fitted.features(rows)), threshold)


def evaluate_heldout(fitted: Fitted, test: DataFrame, y: str = "y", project: str = "project") -> dict[str, DataFrame]:
    """Overall metrics with AP, metrics per project, predictions."""
    scored = materialize(predictions(fitted, test), "heldout")
    overall = classification_metrics(scored, 0.5, y, "tumor_probability")
    per_project = project_metrics(scored, project, y, "tumor_probability")
    one_class = per_project.where("n_tumor = 0 or n_normal = 0").select(project).limit(5).collect()
    if one_class:
        raise ValueError(f"held-out projects with one class only: {[r[0] for r in one_class]}")
    return {"metrics": overall, "per_project": per_project, "predictions": scored}


def _folded(rows: DataFrame, n_folds: int, seed: int, group: str, strata: Sequence[str]) -> DataFrame:
    folds = grouped_stratified_folds(rows, n_folds, seed, group, strata)
    folded = materialize(with_folds(rows, folds, group), "folds", by="fold")
    require(dependency_issues(folded, group, "fold"), "folds share patients")
    return folded


def grouped_cv(rows: DataFrame, genes: Sequence[str], k: int, c: float, n_folds: int = 5, seed: int = 1, y: str = "y", group: str = "case_id", strata: Sequence[str] = ("project", "y")) -> DataFrame:
    """AUC per patient-disjoint fold; every stage is refitted inside the fold."""
    folded = _folded(rows, n_folds, seed, group, strata)
    fits = fit_sides(folded, y, genes, k, c, "binomial", "fold", range(n_folds))
    scored = union_predictions([predictions(fits[f], folded.where(F.col("fold") == f)) for f in fits], folded)
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n_validation"))
    total = F.sum("n_validation").over(Window.partitionBy(F.lit(0)))
    # One row per fold.
    return roc_auc(scored, y, "tumor_probability", ["fold"]).join(sizes, "fold").select(
        (F.col("fold") + 1).alias("fold"), (total - F.col("n_validation")).alias("n_train"), "n_validation", "auc"
    ).orderBy("fold")


def oof_predictions(rows: DataFrame, genes: Sequence[str], k: int, c: float, n_folds: int = 5, seed: int = 42, y: str = "y", group: str = "case_id") -> DataFrame:
    """Out-of-fold class and confidence; each sample exactly once."""
    per_class = rows.groupBy(y).agg(F.count_distinct(group).alias("patients"))
    thin = per_class.where(F.col("patients") < n_folds).limit(5).collect()
    if thin:
        raise ValueError(f"classes with fewer patients than folds: {[r[y] for r in thin]}")
    folded = _folded(rows, n_folds, seed, group, [y])
    fits = fit_sides(folded, y, genes, k, c, "multinomial", "fold", range(n_folds))
    parts = [
        score_aligned(fits[f].features(folded.where(F.col("fold") == f))).select(
            "sample", group, (F.col("fold") + 1).alias("fold"), F.col(y).cast("string").alias("true_type"),
            argmax_class("probability", fits[f].model.classes).alias("predicted_type"), F.array_max("probability").alias("confidence"),
        )
        for f in fits
    ]
    scored = union_predictions(parts, folded)
    return scored.withColumn("correct", F.when(F.col("true_type") == F.col("predicted_type"), 1).otherwise(0))


def fold_metrics(oof: DataFrame, labels: Sequence[str], group: str = "case_id") -> DataFrame:
    """Per fold: sizes, patients, accuracy, macro F1 over all labels."""
    base = oof.groupBy("fold").agg(
        F.count("*").alias("n_test"), F.count_distinct(group).alias("n_test_patients"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )
    w = Window.partitionBy(F.lit(0))
    # One row per fold; patients do not cross folds, so totals are sums.
    sized = base.select(
        "*", (F.sum("n_test").over(w) - F.col("n_test")).alias("n_train"),
        (F.sum("n_test_patients").over(w) - F.col("n_test_patients")).alias("n_train_patients"),
    )
    sides = oof.select(
        "fold", F.inline(class_sides(F.col("true_type"), F.col("predicted_type"), F.lit(1), F.col("correct"), F.lit(0)))
    ).groupBy("fold", "label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("called")).cast("double")), F.lit(0.0))
    macro = sides.groupBy("fold").agg((F.sum(f1) / len(labels)).alias("macro_f1"))
    return sized.join(macro, "fold").select("fold", "n_train", "n_test", "n_train_patients", "n_test_patients", "accuracy", "macro_f1").orderBy("fold")


def oof_report(oof: DataFrame, labels: Sequence[str]) -> dict[str, DataFrame]:
    """Per-class table by F1, confusion matrix, headline numbers."""
    matrix = confusion_matrix(oof, "true_type", "predicted_type", labels)
    prf = per_class_prf(matrix)
    parts = [accuracy(oof, "true_type", "predicted_type"), balanced_accuracy(oof, "true_type", "predicted_type"), macro_weighted_f1(prf)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return {
        "per_class": prf.withColumnRenamed("label", "cancer_type").orderBy(F.desc("f1"), "cancer_type"),
        "confusion": matrix,
        "summary": merged.agg(*[F.max(c).alias(c) for c in merged.columns]),
        "folds": fold_metrics(oof, labels),
    }


def loco(rows: DataFrame, genes: Sequence[str], k: int = 2000, c: float = 0.1, y: str = "y", project: str = "project", group: str = "case_id") -> dict[str, DataFrame]:
    """Hold out each cancer type in turn; refit everything on the others."""
    splits = loco_splits(rows, project, y, group).orderBy("held_out_type").collect()
    bad = [s["held_out_type"] for s in splits if not s["valid"]]
    if bad or len(splits) < 2:
        raise ValueError(f"types that cannot be held out: {bad}")
    split = materialize(rows, "by-type", by=project)
    names = [s["held_out_type"] for s in splits]
    fits = fit_sides(split, y, genes, k, c, "binomial", project, names)
    parts = [
        predictions(fits[name], split.where(F.col(project) == name)).select(
            "sample", group, F.lit(name).alias("held_out_type"), F.col(y).alias("label"), "tumor_probability", "call"
        )
        for name in names
    ]
    scored = union_predictions(parts, split)
    per_type = type_metrics(scored)
    return {"per_type": per_type, "pooled": pooled_and_macro(scored, per_type), "predictions": scored}


def training_summary(fitted: Fitted, n_train: int, n_test: int, heldout: DataFrame, cv: DataFrame | None, k: int, c: float) -> DataFrame:
    """One row with counts, held-out metrics, CV summary and the configuration."""
    config = json.dumps(
        {
            "stages": ["anova_f", "scale", "logistic_regression"],
            "k": k,
            "C": c,
            "class_weight": "balanced",
            "heldout_threshold": 0.5,
            "group": "case_id",
            "stratification": "project + label",
            "iterations": fitted.iterations,
        },
        sort_keys=True,
    )
    metrics = heldout.select("auc", "average_precision", "accuracy", "f1")
    if cv is not None:
        metrics = metrics.unionByName(cv_summary(cv), allowMissingColumns=True)
    return metrics.agg(*[F.max(c_).alias(c_) for c_ in metrics.columns]).select(
        F.lit(n_train).alias("n_train"), F.lit(n_test).alias("n_test"), "*", F.lit(config).alias("config")
    )


def tumor_types(rows: DataFrame, project: str = "project", y: str = "y", group: str = "case_id") -> DataFrame:
    """Tumor rows with the bare type code as target."""
    tumors = rows.where(F.col(y) == 1).withColumn("type_code", project_code(project))
    if not tumors.where("type_code is null").isEmpty():
        raise ValueError("tumor projects must have the form TCGA-<TYPE>")
    require(dependency_issues(tumors, group, "type_code"), "tumor cases")
    return tumors

