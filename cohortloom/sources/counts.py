"""Per-sample count files and gene-by-sample matrices of data providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import decode_log2_tpm001, log2_tpm1, to_number
from ..operators.align import drop_all_missing_genes, repeated_cells, select_genes
from ..operators.checks import counted, offenders, require, union_all
from ..session import few_listing_tasks, materialize, small_side
from .matrix import ExpressionMatrix, gene_row_cells, matrix_from_long


def genes_frame(spark: SparkSession, genes: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(genes)), "pos int, gene_id string")


# The file's own name without its extensions.
FILE_NAME = r"([^/]+?)(?:\.[^/]*)?$"


def count_file_lines(spark: SparkSession, path: str, file_id: str = FILE_NAME) -> DataFrame:
    """Data lines of STAR-style files: ``file_id, gene_id, tpm_text``.

    Comment and blank lines are skipped; ``file_id`` is the pattern that takes
    the id from a path. The line with a ``gene_id`` field names a file's columns,
    whose order may differ from file to file. A file without such a line or
    without ``tpm_unstranded``, or with two different ones, is refused.
    """
    with few_listing_tasks(spark):
        text = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line")
    ).where("line <> '' and not startswith(line, '#')")
    f = F.split("line", "\t")
    head = F.when(F.array_contains(f, "gene_id"), F.col("line"))
    # One row per file; a task sends one for each file it reads.
    found = lines.groupBy("file").agg(F.min(head).alias("head"), F.max(head).alias("last"))
    named = F.split("head", "\t")
    heads = materialize(
        found.select("file", "head", "last", *[(F.array_position(named, c) - 1).cast("int").alias(a) for c, a in (("gene_id", "gene_at"), ("tpm_unstranded", "tpm_at"))]),
        "count-heads",
    )
    if heads.isEmpty():
        raise ValueError(f"no lines in {path}")
    bad = [("head is null", "no_header"), ("tpm_at < 0", "no_tpm_column"), ("head <> last", "several_headers")]
    require(union_all([offenders(heads.where(rule), "file", "count_files", code) for rule, code in bad]), path)
    own = lines.join(small_side(heads.drop("last")), "file").where("line <> head")
    return own.select(F.regexp_extract("file", file_id, 1).alias("file_id"), F.get(f, F.col("gene_at")).alias("gene_id"), F.get(f, F.col("tpm_at")).alias("tpm_text"))


def count_issues(cells: DataFrame) -> DataFrame:
    """Bad TPM values and two rows of one file on the same model gene."""
    return union_all(
        [
            counted(cells, {("count_files", "ERROR", "non_numeric_tpm"): F.col("bad") > 0, ("count_files", "ERROR", "negative_tpm"): F.col("low") < 0}),
            offenders(cells.where("copies > 1"), F.concat_ws(":", "file_id", "target"), "count_files", "repeated_gene"),
        ]
    )


def read_count_files(spark: SparkSession, path: str, genes: Sequence[str], file_id: str = FILE_NAME) -> DataFrame:
    """``file_id, gene_id, value`` with value = log2(tpm+1), model genes only.

    The text is read for the headers and once more: rows of other genes go before the shuffle, and what is
    left is written to the shared folder, checked there and handed on.
    """
    cells = select_genes(count_file_lines(spark, path, file_id), genes_frame(spark, genes))
    value = to_number("tpm_text")
    cells = cells.groupBy("file_id", "target").agg(
        F.count("*").alias("copies"), F.count_if(value.isNull()).alias("bad"), F.min(value).alias("low"), F.max(value).alias("tpm")
    )
    cells = materialize(cells, "count-cells")
    if cells.isEmpty():
        raise ValueError(f"no wanted gene in {path}")
    require(count_issues(cells), path)
    return cells.select("file_id", F.col("target").alias("gene_id"), log2_tpm1("tpm").alias("value"))


def files_to_matrix(cells: DataFrame, genes: Sequence[str], sample: str = "file_id") -> ExpressionMatrix:
    """Long cells to rows: genes in model order, all-missing genes left out."""
    kept = drop_all_missing_genes(cells)
    # One name per model gene.
    present = {r["gene_id"] for r in kept.select("gene_id").distinct().collect()}
    order = [g for g in genes if g in present]
    if not order:
        raise ValueError("no usable model gene is left")
    return matrix_from_long(kept, order, sample)


def gene_row_issues(cells: DataFrame, samples: DataFrame | None) -> DataFrame:
    """Checks of gene-by-sample files over the wanted cells."""
    value = F.col("cell")
    parts = [
        counted(
            cells,
            {
                ("gene_rows", "ERROR", "short_row"): value.isNull(),
                ("gene_rows", "ERROR", "blank_gene"): F.trim("gene_id") == "",
                ("gene_rows", "ERROR", "invalid_value"): value.isNotNull() & decode_log2_tpm001(to_number("cell")).isNull(),
            },
        ),
        offenders(repeated_cells(cells, "sample", "target"), "target", "gene_rows", "repeated_gene"),
    ]
    if samples is not None:
        parts.append(offenders(samples.select("sample").join(cells.select("sample").distinct(), "sample", "left_anti"), "sample", "gene_rows", "missing_sample"))
    return union_all(parts)


def read_gene_by_sample(spark: SparkSession, path: str, genes: Sequence[str], samples: DataFrame | None = None, sep: str = "\t") -> DataFrame:
    """``sample, gene_id, value`` on the model scale from log2(tpm+0.001) files.

    Unwanted gene rows go before cells are expanded, unwanted samples after.
    """
    # Rows without a gene id are carried along to be refused.
    wanted = genes_frame(spark, [*genes, ""])
    cells = select_genes(gene_row_cells(spark, path, sep, wanted), wanted)
    if samples is not None:
        cells = cells.join(samples.select("sample").distinct(), "sample", "left_semi")
    cells = materialize(cells, "gene-row-cells")
    require(gene_row_issues(cells, samples), path)
    if cells.isEmpty():
        raise ValueError(f"no wanted gene or sample in {path}")
    return cells.select("sample", F.col("target").alias("gene_id"), decode_log2_tpm001(to_number("cell")).alias("value"))

