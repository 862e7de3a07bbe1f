"""Per-gene explanations of a two-class score, and model gene tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import strip_version
from ..functions.numeric import array_sum, direction_if_high, double_array, is_finite, sigmoid, string_array
from ..session import small_side
from ..sources.matrix import ExpressionMatrix
from .align import Aligned, align
from .checks import CONTRACTS, gene_metadata_issues, require
from .model import LinearModel, require_tumor_model
from .score import linear_terms, standardize


def _ranked(terms: Column, sign: int, top_n: int) -> Column:
    """Positions of the strongest terms of one sign; ties go by gene id."""
    chosen = F.filter(terms, lambda t: t["term"] * sign > 0)
    ordered = F.array_sort(F.transform(chosen, lambda t: F.struct((-sign * t["term"]).alias("key"), t["gene"].alias("gene"), t["pos"].alias("pos"))))
    return F.slice(ordered, 1, top_n)


def contributions(a: Aligned) -> DataFrame:
    """Row-local: ``x`` imputed values, ``z``, ``term`` = z * coef, and the logit."""
    keep = [c for c in a.rows.columns if c != "x"]
    z = a.rows.select(*keep, a.imputed().alias("x"), standardize(F.col("x"), a.model).alias("z"))
    terms = z.select(*keep, "x", "z", linear_terms("z", a.model.coef[0]).alias("term"))
    total = array_sum(F.col("term")) + F.lit(a.model.intercept[0])
    return terms.select("*", F.when(is_finite(total), total).otherwise(F.raise_error(F.lit("model explanation is non-finite")).cast("double")).alias("logit"))


def top_contributions(a: Aligned, top_n: int = 10) -> DataFrame:
    """At most ``top_n`` genes per sample and direction, without a shuffle.

    Each sample's genes are ranked inside its own row.
    """
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    m = a.model
    genes = string_array(m.genes)
    tagged = F.zip_with(
        F.transform("term", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))),
        genes,
        lambda t, g: F.struct(t["term"].alias("term"), g.alias("gene"), t["pos"].alias("pos")),
    )
    base = contributions(a).select("sample", "logit", sigmoid("logit").alias("tumor_probability"), "x", "z", "term", tagged.alias("terms"))
    sides = F.concat(
        *[
            F.transform(
                _ranked(F.col("terms"), sign, top_n),
                lambda r, i: F.struct(F.lit(name).alias("direction"), (i + 1).alias("rank"), r["gene"].alias("gene_id"), r["pos"].alias("pos")),
            )
            for name, sign in (("tumor", 1), ("normal", -1))
        ]
    )
    rows = base.select("sample", "tumor_probability", "logit", "x", "z", "term", F.inline(sides))

    def at(c):
        return F.get(c, F.col("pos"))

    return rows.select(
        "sample", "tumor_probability", "logit", "direction", "rank", "gene_id",
        at(F.col("term")).alias("contribution_logit"),
        at(F.col("x")).alias("expression_log2_tpm1"),
        at(double_array(m.mean)).alias("training_mean"),
        at(F.col("z")).alias("scaled_value"),
        at(double_array(m.coef[0])).alias("lr_coef"),
    )


def top_contributions_long(terms: DataFrame, top_n: int = 10) -> DataFrame:
    """The same ranking over long terms ``(sample, gene_id, term)``."""
    signed = terms.where("term <> 0").withColumn("direction", F.when(F.col("term") > 0, "tumor").otherwise("normal"))
    w = Window.partitionBy("sample", "direction").orderBy(F.desc(F.abs("term")), "gene_id")
    return signed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def gene_name_keys(metadata: DataFrame) -> DataFrame:
    """Name per key, keys being ids and version-free ids."""
    return (
        metadata.select(F.explode(F.array("gene_id", "gene_id_base")).alias("key"), F.coalesce("gene_name", F.lit("")).alias("gene_name"))
        .groupBy("key")
        .agg(F.max("gene_name").alias("gene_name"))
    )


def attach_gene_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Name by id, else by version-free id, else empty. ``names(key, gene_name)``.

    ``names`` is a gene annotation with two rows per known gene. A gene that leads
    in most samples must not meet them in one task, so names go to the rows.
    """
    names = small_side(names)
    by_id = names.select(F.col("key").alias("gene_id"), F.col("gene_name").alias("name_by_id"))
    by_base = names.select(F.col("key").alias("gene_base"), F.col("gene_name").alias("name_by_base"))
    return (
        rows.withColumn("gene_base", strip_version("gene_id"))
        .join(by_id, "gene_id", "left")
        .join(by_base, "gene_base", "left")
        .withColumn("gene_name", F.coalesce("name_by_id", "name_by_base", F.lit("")))
        .drop("gene_base", "name_by_id", "name_by_base")
    )


def known_gene_names(sources: Sequence[DataFrame]) -> DataFrame:
    """Names from several tables; the later table wins per key."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.where("gene_name is not null").select(
            F.explode(F.array_distinct(F.array(F.col("gene_id"), strip_version("gene_id")))).alias("key"), "gene_name", F.lit(i).alias("source")
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("key").agg(F.max_by("gene_name", F.struct("source", "gene_name")).alias("gene_name"))


def explain(model: LinearModel, matrix: ExpressionMatrix, top_n: int = 10, metadata: DataFrame | None = None) -> DataFrame:
    rows = top_contributions(align(matrix, require_tumor_model(model)), top_n)
    if metadata is None:
        named = rows.withColumn("gene_name", F.lit(""))
    else:
        require(gene_metadata_issues(metadata), "gene metadata")
        named = attach_gene_names(rows, gene_name_keys(metadata))
    return named.select(*CONTRACTS["explanations"])


def rank_genes_by_abs_coef(genes: DataFrame, coef: DataFrame) -> DataFrame:
    """1..g by size of coefficient. Model-sized: one row per gene."""
    w = Window.partitionBy("class_idx").orderBy(F.desc(F.abs("coef")), "pos")
    return genes.join(coef, "pos").withColumn("rank_abs_lr_coef", F.row_number().over(w))


def gene_metadata(genes: DataFrame, coef: DataFrame, names: DataFrame) -> DataFrame:
    ranked = rank_genes_by_abs_coef(genes, coef)
    return attach_gene_names(ranked, names).select(
        "rank_abs_lr_coef",
        "gene_id",
        strip_version("gene_id").alias("gene_id_base"),
        "gene_name",
        F.col("coef").alias("lr_coef"),
        F.abs("coef").alias("abs_lr_coef"),
        direction_if_high("coef").alias("direction_if_high"),
        F.col("mean").alias("scaler_mean"),
        F.col("scale").alias("scaler_scale"),
    )


def top_genes_per_class(genes: DataFrame, coef: DataFrame, head: DataFrame, symbols: DataFrame | None = None, k: int = 15) -> DataFrame:
    """Largest coefficients per class, stable by gene position."""
    w = Window.partitionBy("class_idx").orderBy(F.desc("coef"), "pos")
    top = coef.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(genes.select("pos", "gene_id"), "pos").join(head.select("class_idx", "class"), "class_idx")
    if symbols is None:
        top = top.withColumn("symbol", F.lit(""))
    else:
        top = top.join(symbols.select("gene_id", "symbol"), "gene_id", "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))
    return top.select(F.col("class").alias("cancer_type"), "rank", F.col("gene_id").alias("gene"), "symbol", "coef")
