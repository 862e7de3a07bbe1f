"""External validation from source files: manifest and provider files to cohort tables.

One path for each kind of provider: the manifest is checked or drawn from, the files are
read for the model's genes, bound to the manifest's ids, aligned, guarded and scored, and
the cohort's tables are made from predictions that are written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import donor_id
from ..session import materialize
from ..sources.counts import FILE_NAME, files_to_matrix, read_count_files, read_gene_by_sample
from ..sources.matrix import ExpressionMatrix, matrix_from_long
from .align import align, alignment_report
from .checks import offenders, require
from .cohort import (
    biospecimen_audit,
    draw_project_files,
    group_audit,
    phenotype_manifest_issues,
    provider_manifest_issues,
    sample_per_site,
    sample_per_site_overlapping,
    type_label,
    validate_all_normal,
    validate_labelled,
)
from .model import LinearModel
from .score import binary_scores, guard, require_tumor_model, score_aligned


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of one row each, side by side."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def bind_cells(manifest: DataFrame, cells: DataFrame, key: str, context: str) -> DataFrame:
    """Cells of the manifest's ids. An id without a cell is refused; other ids' cells are left out."""
    wanted = manifest.select(key).distinct()
    require(offenders(wanted.join(cells.select(key).distinct(), key, "left_anti"), key, "cohort_files", "no_cells"), context)
    return cells.join(wanted, key, "left_semi")


def _scored(model: LinearModel, matrix: ExpressionMatrix, threshold: float, guards: dict) -> tuple[DataFrame, DataFrame]:
    """Scores and the alignment report (one row) of a matrix that passes the guards."""
    a = align(matrix, require_tumor_model(model))
    a = a.with_rows(materialize(a.rows, "aligned"))
    guard(a, **{"max_invalid_fraction": 0.0, "allow_invalid": False, "min_match_rate": 0.5, "allow_low_coverage": False, **guards})
    return materialize(binary_scores(score_aligned(a), threshold), "scores"), alignment_report(a)


def validate_count_files(
    model: LinearModel, manifest: DataFrame, path: str, preset: str = "native", threshold: float = 0.5, project: str | None = None,
    n_per_class: int | None = None, seed: int = 0, disjoint: bool = True, file_id: str = FILE_NAME, **guards,
) -> dict[str, DataFrame]:
    """A labelled cohort from a flattened file manifest and one count file per sample.

    Without ``n_per_class`` every file of the manifest is validated (``locked``), else as
    many donors of each class are drawn first (``sampled``). The result has the tables of
    ``validate_labelled``, an ``audit`` with donors and biospecimens, and ``alignment``.
    """
    if n_per_class is None:
        require(provider_manifest_issues(manifest, project), "manifest")
        chosen = manifest.withColumn("label", type_label())
    else:
        if project is None:
            raise ValueError("a draw needs a project")
        chosen = draw_project_files(manifest, project, n_per_class, seed, disjoint)
    chosen = materialize(chosen.withColumn("donor_id", F.col("case_submitter_id")), "cohort")
    cells = bind_cells(chosen, read_count_files(manifest.sparkSession, path, model.genes, file_id), "file_id", path)
    scores, report = _scored(model, files_to_matrix(cells, model.genes), threshold, guards)
    tables = validate_labelled(chosen, scores, preset, "file_id", threshold)
    mode = chosen.agg(F.lit("locked" if n_per_class is None else "sampled").alias("cohort_mode"))
    return tables | {"audit": one_row([group_audit(chosen, "file_id", "donor_id"), biospecimen_audit(chosen), mode]), "alignment": report}


def validate_gene_rows(
    model: LinearModel, phenotype: DataFrame, path: str, study: str = "GTEX", threshold: float = 0.5,
    n_per_site: int | None = None, min_site_n: int = 1, seed: int = 0, disjoint: bool = True, **guards,
) -> dict[str, DataFrame]:
    """An all-normal cohort from a phenotype table and gene-by-sample files.

    Without ``n_per_site`` every sample of the study is validated, else donors are drawn
    per site first. The result has the tables of ``validate_all_normal`` and ``alignment``.
    """
    own = phenotype.where(F.col("study") == study)
    require(phenotype_manifest_issues(own, study), "phenotype")
    if n_per_site is None:
        chosen = own.withColumn("donor_id", donor_id("sample"))
    else:
        chosen = (sample_per_site if disjoint else sample_per_site_overlapping)(own, n_per_site, min_site_n, seed)
    chosen = materialize(chosen, "cohort")
    cells = read_gene_by_sample(phenotype.sparkSession, path, model.genes, chosen)
    present = {r["gene_id"] for r in cells.select("gene_id").distinct().collect()}  # a model's genes at most
    scores, report = _scored(model, matrix_from_long(cells, [g for g in model.genes if g in present], "sample"), threshold, guards)
    tables = validate_all_normal(chosen, scores, "sample", threshold)
    mode = chosen.agg(F.lit("locked" if n_per_site is None else "sampled").alias("cohort_mode"))
    return tables | {"audit": one_row([group_audit(chosen, "sample", "donor_id"), mode]), "alignment": report}
