"""The whole run: QC, guards, scores, explanations, calibration, one manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import check_fraction
from ..session import materialize
from ..sources.matrix import ExpressionMatrix
from ..sources.tables import write_report_json, write_table
from .align import align, alignment_issues, alignment_report, worst_invalid
from .calibrate import calibrate
from .explain import attach_gene_names, gene_name_keys, top_contributions
from .checks import CONTRACTS, gene_metadata_issues, require
from .model import LinearModel, require_tumor_model
from .qc import inspect_aligned, report_frame
from .score import binary_scores, score_aligned

MANIFEST_SCHEMA = (
    "run_id string, status string, threshold double, samples bigint, input_genes int, matched_model_genes int, missing_model_genes int, "
    "qc_status string, invalid_matched_cells bigint, tumor_calls bigint, normal_calls bigint, outputs string, calibration_json string, error string"
)


def run_workflow(
    spark: SparkSession,
    model: LinearModel,
    matrix: ExpressionMatrix,
    output: str,
    labels: DataFrame | None = None,
    threshold: float = 0.5,
    top_n: int = 10,
    gene_metadata: DataFrame | None = None,
    extra_thresholds: Sequence[float] = (),
    min_match_fraction: float = 1.0,
    max_invalid_fraction: float = 0.0,
    expected_class: str = "unknown",
    rules: dict | None = None,
    allow_qc_fail: bool = False,
    allow_invalid: bool = False,
    skip_explanations: bool = False,
) -> DataFrame:
    """Write ``output/run=<id>/...`` and append the manifest row last.

    Stop states: ``stopped_after_qc_fail`` and ``stopped_after_invalid_input``
    write no scores, ``stopped_after_calibration_error`` keeps them. A reader
    that follows the manifest never sees a half-written run. Alignment is done
    once and read back from the shared folder by every later step.
    """
    check_fraction(threshold)
    a = align(matrix, require_tumor_model(model))
    a = a.with_rows(materialize(a.rows, "aligned"))
    run_id = uuid.uuid4().hex
    base = f"{output.rstrip('/')}/run={run_id}"
    outputs: list[str] = []
    facts = {
        "run_id": run_id, "threshold": float(threshold), "input_genes": len(matrix.genes), "matched_model_genes": a.n_matched,
        "missing_model_genes": len(a.positions) - a.n_matched,
    }

    def finish(status: str, **more) -> DataFrame:
        row = {**facts, **more, "status": status, "outputs": ",".join(outputs)}
        names = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
        manifest = spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST_SCHEMA)
        manifest.coalesce(1).write.mode("append").parquet(f"{output.rstrip('/')}/manifest")
        return manifest

    def write(name: str, df: DataFrame) -> None:
        write_table(df, f"{base}/{name}")
        outputs.append(name)

    qc = inspect_aligned(a, len(matrix.genes), threshold, expected_class, rules)
    facts.update(samples=qc["shape"]["samples"], qc_status=qc["status"])
    write_report_json(report_frame(spark, {"input": qc}), f"{base}/qc")
    outputs.append("qc")
    if qc["status"] == "FAIL" and not allow_qc_fail:
        return finish("stopped_after_qc_fail")

    facts["invalid_matched_cells"] = 0
    invalid = []
    if worst_invalid(a):
        report = materialize(alignment_report(a), "alignment-report")
        facts["invalid_matched_cells"] = report.head()["invalid_matched_cells"]
        invalid = alignment_issues(report, max_invalid_fraction).collect()
    if invalid and not allow_invalid:
        return finish("stopped_after_invalid_input", error="; ".join(r["message"] for r in invalid))

    write("scores", binary_scores(score_aligned(a), threshold))
    scores = spark.read.schema("sample string, tumor_probability double, call string").csv(f"{base}/scores", header=True)
    calls = scores.agg(F.count_if(F.col("call") == "tumor").alias("t"), F.count_if(F.col("call") == "normal").alias("n")).head()
    facts.update(tumor_calls=calls["t"], normal_calls=calls["n"])

    summary = None
    if labels is not None:
        try:
            table, summary_frame = calibrate(scores, labels, extra_thresholds, threshold, min_match_fraction)
        except ValueError as problem:
            return finish("stopped_after_calibration_error", error=str(problem))
        write("thresholds", table)
        summary = summary_frame.head().asDict(recursive=True)
        write_report_json(summary_frame, f"{base}/calibration")
        outputs.append("calibration")
    if not skip_explanations:
        rows = top_contributions(a, top_n)
        if gene_metadata is None:
            rows = rows.withColumn("gene_name", F.lit(""))
        else:
            require(gene_metadata_issues(gene_metadata), "gene metadata")
            rows = attach_gene_names(rows, gene_name_keys(gene_metadata))
        write("explanations", rows.select(*CONTRACTS["explanations"]))
    return finish("complete", calibration_json=None if summary is None else json.dumps(summary))
