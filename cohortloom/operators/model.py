"""Linear models as tables, and their bounded driver-side form for scoring.

Tables: ``genes(pos, gene_id, mean, scale)``, ``coef(class_idx, pos, coef)`` and
``head(class_idx, class, intercept)``. A two-class model has one coefficient row
(class_idx 1) and two head rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import NORMAL_ROLES, TUMOR_ROLES, binary_role, key_problem, strip_version
from ..functions.numeric import double_array, is_finite
from .checks import counted, offenders, require, union_all

# A model goes to every task with the plan; its size is checked before.
MAX_COEFFICIENTS = 20_000_000


@dataclass(frozen=True)
class LinearModel:
    genes: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]
    classes: tuple[str, ...]
    meta: dict = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return "binary" if len(self.coef) == 1 else "multiclass"

    def literals(self):
        """mean, scale and one coefficient array per class as Columns."""
        return double_array(self.mean), double_array(self.scale), [double_array(c) for c in self.coef]


@dataclass(frozen=True)
class ModelTables:
    genes: DataFrame
    coef: DataFrame
    head: DataFrame
    kind: str | None = None

    def load(self) -> LinearModel:
        """Validate, check the size and bring the model to the driver."""
        require(model_issues(self), "model")
        size = self.coef.count()
        if size > MAX_COEFFICIENTS:
            raise ValueError(f"model has {size} coefficients; at most {MAX_COEFFICIENTS} are shipped with a plan")
        return collect_model(self)


def collect_model(tables: ModelTables) -> LinearModel:
    """The model as it is, for tables already known to be sound."""
    genes = tables.genes.orderBy("pos").collect()
    at = {r["pos"]: i for i, r in enumerate(genes)}
    head = tables.head.orderBy("class_idx").collect()
    weights: dict[int, list[float]] = {}
    for r in tables.coef.collect():
        weights.setdefault(r["class_idx"], [0.0] * len(genes))[at[r["pos"]]] = float(r["coef"])
    rows = sorted(weights)
    intercept = {r["class_idx"]: float(r["intercept"]) for r in head}
    return LinearModel(
        genes=tuple(r["gene_id"] for r in genes),
        mean=tuple(float(r["mean"]) for r in genes),
        scale=tuple(float(r["scale"]) for r in genes),
        coef=tuple(tuple(weights[k]) for k in rows),
        intercept=tuple(intercept[k] for k in rows),
        classes=tuple(r["class"] for r in head),
    )


def model_tables(spark: SparkSession, model: LinearModel) -> ModelTables:
    genes = spark.createDataFrame(
        [(i, g, m, s) for i, (g, m, s) in enumerate(zip(model.genes, model.mean, model.scale))],
        "pos int, gene_id string, mean double, scale double",
    )
    first = 1 if model.kind == "binary" else 0
    coef = spark.createDataFrame(
        [(k + first, i, c) for k, row in enumerate(model.coef) for i, c in enumerate(row)],
        "class_idx int, pos int, coef double",
    )
    intercept = (0.0, model.intercept[0]) if model.kind == "binary" else model.intercept
    head = spark.createDataFrame(
        [(k, c, float(b)) for k, (c, b) in enumerate(zip(model.classes, intercept))],
        "class_idx int, class string, intercept double",
    )
    return ModelTables(genes, coef, head, model.kind)


def write_model(tables: ModelTables, path: str) -> str:
    tables.genes.select("pos", "gene_id", strip_version("gene_id").alias("gene_base"), "mean", "scale").write.parquet(f"{path}/genes")
    tables.coef.write.parquet(f"{path}/coef")
    tables.head.write.parquet(f"{path}/head")
    return path


def read_model(spark: SparkSession, path: str, kind: str | None = None) -> ModelTables:
    return ModelTables(
        spark.read.parquet(f"{path}/genes"), spark.read.parquet(f"{path}/coef"), spark.read.parquet(f"{path}/head"), kind
    )


def model_issues(tables: ModelTables) -> DataFrame:
    """Shape, finiteness, positive scale, unique genes and classes, kind."""
    genes, coef, head = tables.genes, tables.coef, tables.head
    by_base = genes.groupBy(strip_version("gene_id").alias("base")).agg(
        F.count("*").alias("n"), F.count_distinct("gene_id").alias("ids")
    )
    by_gene = genes.groupBy("gene_id").count().where("count > 1")
    expected = 2 if tables.kind == "binary" else None
    shape = (
        coef.groupBy("class_idx").agg(F.count_distinct("pos").alias("g"), F.count("*").alias("cells"))
        .select(F.lit("coef").alias("t"), "class_idx", "g", "cells")
        .unionByName(genes.agg(F.count("*").alias("g"), F.count_distinct("pos").alias("cells")).select(F.lit("genes").alias("t"), F.lit(-1).alias("class_idx"), "g", "cells"))
        .unionByName(head.agg(F.count("*").alias("g"), F.count_distinct("class_idx").alias("cells")).select(F.lit("head").alias("t"), F.lit(-1).alias("class_idx"), "g", "cells"))
        .agg(
            F.max(F.when(F.col("t") == "genes", F.col("g"))).alias("n_genes"),
            F.max(F.when(F.col("t") == "genes", F.col("cells"))).alias("n_pos"),
            F.max(F.when(F.col("t") == "head", F.col("g"))).alias("n_classes"),
            F.count_if(F.col("t") == "coef").alias("coef_rows"),
            F.min(F.when(F.col("t") == "coef", F.col("g"))).alias("least"),
            F.max(F.when(F.col("t") == "coef", F.col("cells"))).alias("most"),
        )
    )
    n_rows, n_classes = F.col("coef_rows"), F.col("n_classes")
    shape_ok = (
        (F.col("n_genes") > 0)
        & (F.col("n_pos") == F.col("n_genes"))
        & (F.coalesce("least", F.lit(-1)) == F.col("n_genes"))
        & (F.coalesce("most", F.lit(-1)) == F.col("n_genes"))
    )
    classes_ok = ((n_rows == 1) & (n_classes == 2)) | ((n_rows > 1) & (n_rows == n_classes))
    kind_ok = F.lit(True) if tables.kind is None else (
        (n_rows == 1) if expected else (n_rows > 1)
    )
    return union_all(
        [
            counted(
                shape,
                {
                    ("model", "ERROR", "shape_mismatch"): ~shape_ok,
                    ("model", "ERROR", "class_count_mismatch"): ~classes_ok,
                    ("model", "ERROR", "kind_mismatch"): ~kind_ok,
                },
            ),
            counted(
                genes,
                {
                    ("genes", "ERROR", "unclean_gene_id"): key_problem("gene_id").isNotNull(),
                    ("genes", "ERROR", "non_finite_scaler"): ~(is_finite("mean") & is_finite("scale")),
                    ("genes", "ERROR", "non_positive_scale"): F.coalesce(F.col("scale") <= 0, F.lit(False)),
                },
            ),
            counted(coef, {("coef", "ERROR", "non_finite_coef"): ~is_finite("coef")}),
            counted(
                head,
                {
                    ("head", "ERROR", "non_finite_intercept"): ~is_finite("intercept"),
                    ("head", "ERROR", "unclean_class"): key_problem("class").isNotNull(),
                },
            ),
            offenders(by_gene, "gene_id", "genes", "duplicate_gene"),
            offenders(by_base.where("n > 1 and ids = n"), "base", "genes", "version_collision"),
            offenders(head.groupBy("class").count().where("count > 1"), "class", "head", "duplicate_class"),
        ]
    )


def tumor_model_issues(tables: ModelTables) -> DataFrame:
    """Class 0 must mean normal and class 1 tumor."""
    wanted = F.when(F.col("class_idx") == 0, F.lit("normal")).when(F.col("class_idx") == 1, F.lit("tumor"))
    wrong = tables.head.where(~F.coalesce(binary_role("class") == wanted, F.lit(False)))
    return offenders(wrong, "class", "head", "class_order")


def require_tumor_model(model: LinearModel) -> LinearModel:
    if model.kind != "binary":
        raise ValueError("a two-class model is needed here")
    names = [str(c).strip().lower() for c in model.classes]
    if len(names) != 2 or names[0] not in NORMAL_ROLES or names[1] not in TUMOR_ROLES:
        raise ValueError(f"expected classes meaning (normal, tumor), got {list(model.classes)}")
    return model


def make_model(
    genes: Sequence[str],
    mean: Sequence[float],
    scale: Sequence[float],
    coef,
    intercept,
    classes: Sequence[str] = ("normal", "tumor"),
) -> LinearModel:
    """A model from plain lists, refused when malformed."""
    nested = bool(len(coef)) and isinstance(coef[0], (list, tuple))
    rows = tuple(tuple(float(v) for v in r) for r in (coef if nested else [coef]))
    cuts = tuple(float(v) for v in intercept) if isinstance(intercept, (list, tuple)) else (float(intercept),)
    values = [*mean, *scale, *(v for r in rows for v in r), *cuts]
    if any(v != v or v in (float("inf"), float("-inf")) for v in map(float, values)):
        raise ValueError("model values must be finite")
    if any(s <= 0 for s in scale):
        raise ValueError("model scale values must be positive")
    if len(set(genes)) != len(genes) or not len(genes):
        raise ValueError("model genes must be unique and at least one")
    if len(mean) != len(genes) or len(scale) != len(genes) or any(len(r) != len(genes) for r in rows):
        raise ValueError("model arrays must have one value per gene")
    if len(cuts) != len(rows) or len(classes) != (2 if len(rows) == 1 else len(rows)) or len(set(classes)) != len(classes):
        raise ValueError("model classes and intercepts must match the coefficient rows")
    return LinearModel(
        tuple(map(str, genes)), tuple(map(float, mean)), tuple(map(float, scale)), rows, cuts, tuple(map(str, classes))
    )


def compare_models(left: ModelTables, right: ModelTables, tolerance: float = 1e-6) -> DataFrame:
    """Largest difference per array, and whether genes, order and classes agree."""
    g = left.genes.alias("a").join(right.genes.alias("b"), "pos", "full_outer")
    same_gene = F.col("a.gene_id").eqNullSafe(F.col("b.gene_id"))

    def part(df, name, a, b, same):
        return df.agg(
            F.count_if(~same).alias("n_identity_changes"),
            F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_delta"),
        ).select(F.lit(name).alias("part"), "n_identity_changes", "max_abs_delta")

    c = left.coef.alias("a").join(right.coef.alias("b"), ["class_idx", "pos"], "full_outer")
    h = left.head.alias("a").join(right.head.alias("b"), "class_idx", "full_outer")
    both = F.col("a.coef").isNotNull() & F.col("b.coef").isNotNull()
    return union_all(
        [
            part(g, "mean", "a.mean", "b.mean", same_gene),
            part(g, "scale", "a.scale", "b.scale", same_gene),
            part(c, "coef", "a.coef", "b.coef", both),
            part(h, "intercept", "a.intercept", "b.intercept", F.col("a.class").eqNullSafe(F.col("b.class"))),
        ]
    ).withColumn("within_tolerance", (F.col("n_identity_changes") == 0) & (F.coalesce("max_abs_delta", F.lit(0.0)) <= tolerance))
