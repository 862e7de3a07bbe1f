import gzip
import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.sources import counts, features, manifest, matrix as mx, tables


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def cells(m):
    return {r["sample"]: r["cells"] for r in m.rows.collect()}


@pytest.mark.parametrize("ext,sep", [("csv", ","), ("tsv", "\t"), ("txt", "\t")])
def test_delimited(spark, tmp_path, ext, sep):
    p = put(tmp_path / f"m.{ext}", f"sample{sep}ENSG1.2{sep}ENSG2\r\n001{sep}1.5{sep}NA\r\nNA{sep}2{sep}\r\n")
    m = mx.read_matrix(spark, p)
    assert m.genes == ("ENSG1.2", "ENSG2")
    assert cells(m) == {"001": ["1.5", "NA"], "NA": ["2", ""]}
    assert {(r["sample"], r.gene_id): r.value for r in m.long().collect()} == {("001", "ENSG1.2"): 1.5, ("001", "ENSG2"): None, ("NA", "ENSG1.2"): 2.0, ("NA", "ENSG2"): None}


def test_quotes_and_bom(spark, tmp_path):
    p = put(tmp_path / "m.csv", '﻿"sample","g,1",g2\n"a ""x"", y","1.5",2\nb,3,"4"\n')
    m = mx.read_matrix(spark, p)
    assert m.genes == ("g,1", "g2")
    assert cells(m) == {'a "x", y': ["1.5", "2"], "b": ["3", "4"]}


def test_header_line_as_data_is_kept(spark, tmp_path):
    """Only a file's first line is its header."""
    p = put(tmp_path / "m.csv", "sample,g1\na,1\nsample,g1\n")
    assert cells(mx.read_matrix(spark, p)) == {"a": ["1"], "sample": ["g1"]}


@pytest.mark.parametrize(
    "text,problem",
    [
        ("sample,g1,g1\na,1,2\n", "duplicate gene"),
        ("sample,g1,\na,1,2\n", "non-empty"),
        ("sample, g1\na,1\n", "padded"),
        ("ENSG000001.2,ENSG000002\n1,2\n", "looks like a gene"),
        ("sample\na\n", "at least one gene"),
        ("sample,g1\n", "at least one sample"),
        ("sample,g1\na,1\na,2\n", "duplicate"),
        ("sample,g1\n a,1\n", "padded"),
        ("sample,g1\n,1\n", "missing|blank"),
        ("", "empty"),
    ],
)
def test_bad_matrices(spark, tmp_path, text, problem):
    with pytest.raises(ValueError, match=problem):
        mx.read_matrix(spark, put(tmp_path / "m.csv", text))


def test_unsupported_format(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        mx.read_matrix(spark, put(tmp_path / "m.pkl", "x"))


def test_index_column(spark, tmp_path):
    p = put(tmp_path / "m.csv", "g1,name,g2\n1,007,2\n3,NA,4\n")
    for at in ("name", 1, -2):
        m = mx.read_matrix(spark, p, index_col=at)
        assert m.genes == ("g1", "g2") and cells(m) == {"007": ["1", "2"], "NA": ["3", "4"]}
    for at in ("nope", 3, -4):
        with pytest.raises(ValueError):
            mx.read_matrix(spark, p, index_col=at)


def test_parquet_with_and_without_index(spark, tmp_path):
    df = pd.DataFrame({"g1": [1.0, 2.0], "g2": [3.0, np.nan]}, index=["a", "b"])
    df.to_parquet(tmp_path / "i.parquet")
    df.rename_axis("sample").reset_index().to_parquet(tmp_path / "n.parquet", index=False)
    for name in ("i", "n"):
        m = mx.read_matrix(spark, str(tmp_path / f"{name}.parquet"))
        assert m.genes == ("g1", "g2")
        got = {(r["sample"], r.gene_id): r.value for r in m.long().collect()}
        assert got == {("a", "g1"): 1.0, ("a", "g2"): 3.0, ("b", "g1"): 2.0, ("b", "g2"): None}


def test_parquet_reads_only_model_genes(spark, tmp_path):
    df = pd.DataFrame({"sample": ["a"], **{f"ENSG{i}.1": [float(i)] for i in range(50)}})
    df.to_parquet(tmp_path / "m.parquet", index=False)
    m = mx.read_parquet_genes(spark, str(tmp_path / "m.parquet"), ["ENSG7", "ENSG3.1", "ENSG99"])
    assert m.genes == ("ENSG3.1", "ENSG7.1") and cells(m) == {"a": [3.0, 7.0]}
    plan = m.rows._jdf.queryExecution().executedPlan().toString()
    assert "ENSG8.1" not in plan


def test_transposed_and_many_blocks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "a.tsv", "gene\ts1\ts2\nENSG2\t3\t4\nENSG1\t1\t2\n")
    put(tmp_path / "t" / "b.tsv", "gene\ts3\nENSG1\t5\nENSG2\tbad\n")
    m = mx.read_matrix(spark, str(tmp_path / "t"), "tsv", transpose=True)
    assert m.genes == ("ENSG2", "ENSG1")
    assert cells(m) == {"s1": ["3", "1"], "s2": ["4", "2"], "s3": ["bad", "5"]}
    one = mx.read_matrix(spark, str(tmp_path / "t" / "a.tsv"), transpose=True)
    assert cells(one) == {"s1": ["3", "1"], "s2": ["4", "2"]}


def test_round_trip_many_parts(spark, matrix, tmp_path):
    m = matrix(["g1", "g2"], {f"s{i}": [i, i / 7] for i in range(50)})
    spread = mx.ExpressionMatrix(m.rows.repartition(6), m.genes)
    for fmt in ("csv", "tsv"):
        back = mx.read_matrix(spark, mx.write_matrix(spread, str(tmp_path / fmt), fmt), fmt)
        assert {s: [float(v) for v in c] for s, c in cells(back).items()} == {f"s{i}": [i, i / 7] for i in range(50)}


def test_read_table(spark, tmp_path):
    p = put(tmp_path / "t.csv", 'sample,label,n,x\n001,NA,1,1.5\n002,"a,b",2,\n')
    t = tables.read_table(spark, p, ["sample"])
    assert [tuple(r) for r in t.orderBy("sample").collect()] == [("001", "NA", 1, "1.5"), ("002", "a,b", 2, "")]
    for header in ("a,,b", "a, b", "a,a"):
        with pytest.raises(ValueError):
            tables.read_table(spark, put(tmp_path / "bad.csv", header + "\n1,2,3\n"))


def test_read_phenotype(spark, tmp_path):
    p = put(tmp_path / "p.tsv", "sample\t_study\t_sample_type\t_primary_site\nGTEX-1\tGTEX\tNormal Tissue\tCaf\xe9\n", "latin-1")
    assert tuple(tables.read_phenotype(spark, p).head()) == ("GTEX-1", "GTEX", "Normal Tissue", "Caf\xe9")
    with pytest.raises(ValueError, match="_primary_site"):
        tables.read_phenotype(spark, put(tmp_path / "q.tsv", "sample\t_study\t_sample_type\nx\ty\tz\n"))


def test_report_json_is_strict(spark):
    df = spark.createDataFrame([(math.inf, [1.0, math.nan], (math.nan, "x"))], "a double, b array<double>, c struct<d:double,e:string>")
    assert json.loads(tables.report_json(df).head()[0]) == {"a": None, "b": [1.0, None], "c": {"d": None, "e": "x"}}


def test_scores_keep_full_precision(spark, tmp_path):
    v = 0.1 + 0.2
    df = spark.createDataFrame([("007", v, "tumor")], "sample string, tumor_probability double, call string")
    back = tables.read_table(spark, tables.write_table(df, str(tmp_path / "s")), ["sample"]).head()
    assert (back["sample"], back.tumor_probability) == ("007", v)


def test_input_snapshot(spark, tmp_path):
    a = tmp_path / "a.txt"
    put(a, "one")
    put(tmp_path / "b.txt", "two")
    first = tables.input_snapshot(spark, [str(tmp_path)]).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.fingerprint for r in first} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("a.txt", "one"), ("b.txt", "two"))}
    before = spark.createDataFrame(first)
    put(a, "changed")
    changed = tables.snapshot_changes(before, tables.input_snapshot(spark, [str(tmp_path)])).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in changed] == ["a.txt"]


STAR = "# gene-model: x\ngene_id\tgene_name\ttpm_unstranded\n\nN_unmapped\t\t\n{}"


def test_count_files(spark, tmp_path):
    put(tmp_path / "f1.counts.tsv", STAR.format("ENSG1.5\tA\t3\nENSG2.1\tB\t0\nENSG9\tZ\t7\n"))
    put(tmp_path / "f2.counts.tsv", STAR.format("ENSG1.7\tA\t1\n"))
    df = counts.read_count_files(spark, str(tmp_path), ["ENSG1.1", "ENSG2.1", "ENSG3"])
    got = {(r.file_id, r.gene_id): r.value for r in df.collect()}
    assert got == {("f1", "ENSG1.1"): 2.0, ("f1", "ENSG2.1"): 0.0, ("f2", "ENSG1.1"): 1.0}
    m = counts.files_to_matrix(df, ["ENSG3", "ENSG2.1", "ENSG1.1"])
    assert m.genes == ("ENSG2.1", "ENSG1.1") and cells(m) == {"f1": [0.0, 2.0], "f2": [None, 1.0]}
    with pytest.raises(ValueError, match="no usable"):
        counts.files_to_matrix(df, ["ENSG3"])


@pytest.mark.parametrize("rows,problem", [("ENSG1.1\tA\tx\n", "non_numeric"), ("ENSG1.1\tA\t-1\n", "negative"), ("ENSG1.1\tA\tinf\n", "non_numeric"), ("ENSG1.1\tA\t1\nENSG1.2\tA\t2\n", "repeated_gene")])
def test_bad_count_files(spark, tmp_path, rows, problem):
    put(tmp_path / "f1.tsv", STAR.format(rows))
    with pytest.raises(ValueError, match=problem):
        counts.read_count_files(spark, str(tmp_path), ["ENSG1"])


def test_count_files_with_other_column_order(spark, tmp_path):
    put(tmp_path / "f1.tsv", STAR.format("ENSG1.5\tA\t3\n"))
    put(tmp_path / "f2.tsv", "tpm_unstranded\tgene_id\n7\tENSG1.1\n")
    got = {r.file_id: r.value for r in counts.read_count_files(spark, str(tmp_path), ["ENSG1"]).collect()}
    assert got == {"f1": 2.0, "f2": 3.0}
    with pytest.raises(ValueError, match="no wanted gene"):
        counts.read_count_files(spark, str(tmp_path), ["ENSG5"])


@pytest.mark.parametrize("text,problem", [("ENSG1.1\tA\t3\n", "no_header"), ("gene_id\tother\nENSG1\t2\n", "no_tpm_column"), ("gene_id\ttpm_unstranded\nENSG1\t2\ntpm_unstranded\tgene_id\n", "several_headers")])
def test_count_files_need_one_header_each(spark, tmp_path, text, problem):
    put(tmp_path / "f1.tsv", STAR.format("ENSG1.5\tA\t3\n"))
    put(tmp_path / "f2.tsv", text)
    with pytest.raises(ValueError, match=problem):
        counts.read_count_files(spark, str(tmp_path), ["ENSG1"])


def gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def test_gene_by_sample(spark, tmp_path):
    v = math.log2(1.001)
    p = gz(tmp_path / "m.tsv.gz", f"sample\tS1\tS2\tS3\nENSG1.3\t{v}\t{v}\tbad\nENSG7\t0\t0\t0\n")
    want = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    got = {(r["sample"], r.gene_id): r.value for r in counts.read_gene_by_sample(spark, p, ["ENSG1.1", "ENSG2"], want).collect()}
    assert got == {("S1", "ENSG1.1"): pytest.approx(1.0), ("S2", "ENSG1.1"): pytest.approx(1.0)}
    with pytest.raises(ValueError, match="missing_sample"):
        counts.read_gene_by_sample(spark, p, ["ENSG1"], spark.createDataFrame([("S9",)], "sample string"))
    with pytest.raises(ValueError, match="invalid_value"):
        counts.read_gene_by_sample(spark, p, ["ENSG1"])


@pytest.mark.parametrize("text,problem", [("sample\tS1\tS1\nENSG1\t0\t0\n", "repeated_gene"), ("sample\tS1\nENSG1.1\t0\nENSG1.2\t0\n", "repeated_gene"), ("sample\tS1\tS2\nENSG1\t0\n", "short_row"), ("sample\tS1\nENSG1\t0\n \t0\n", "blank_gene"), ("sample\tS1\nENSG4\t0\n", "no wanted gene")])
def test_bad_gene_by_sample(spark, tmp_path, text, problem):
    with pytest.raises(ValueError, match=problem):
        counts.read_gene_by_sample(spark, gz(tmp_path / "m.gz", text), ["ENSG1"])


def test_transposed_text_keeps_gene_order_and_skips_blank_lines(spark, tmp_path):
    put(tmp_path / "m.tsv", "id\ts1\ts2\ng9\t1\t2\n\ng1\t3\t4\ng5\t5\t6\n\n")
    m = mx.read_matrix(spark, str(tmp_path / "m.tsv"), transpose=True)
    assert m.genes == ("g9", "g1", "g5") and cells(m) == {"s1": ["1", "3", "5"], "s2": ["2", "4", "6"]}


def test_repeated_gene_in_transposed_text_fails(spark, tmp_path):
    put(tmp_path / "m.tsv", "id\ts1\ng1\t1\ng1\t3\n")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    try:
        with pytest.raises(Exception, match="has a gene twice"):
            mx.read_matrix(spark, str(tmp_path / "m.tsv"), transpose=True).rows.collect()
    finally:
        spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_large_heads_deal_lines_by_salt(spark, tmp_path, monkeypatch):
    put(tmp_path / "m.tsv", "id\ts1\ts2\n" + "".join(f"g{i}\t{i}\t{i + 1}\n" for i in range(50)))
    rows = lambda: sorted(map(tuple, mx.gene_row_cells(spark, str(tmp_path / "m.tsv")).select("gene_id", "sample", "cell").collect()))
    small = rows()
    monkeypatch.setattr(mx, "HEAD_CHARS", 0)
    assert len(small) == 100 and rows() == small


def hit(file_id, *cases):
    return {"file_id": file_id, "file_name": "f", "file_size": 1, "md5sum": "m", "cases": list(cases)}


def case(name, project, *samples):
    return {"submitter_id": name, "project": {"project_id": project}, "samples": [{"submitter_id": s, "sample_type": t} for s, t in samples]}


def test_manifest(spark, tmp_path):
    hits = [
        hit("f1", case("c2", "P", ("s2", "Primary Tumor"), ("s1", "Primary Tumor")), case("c1", "P", ("s1", "Primary Tumor"))),
        hit("f2", case("c3", "P", ("s3", "Primary Tumor"), ("s4", "Solid Tissue Normal"))),
        hit("f3", case("c4", "Q", ("s5", "Metastatic"))),
        hit("f4", case("c5", "Q", ("s6", "Solid Tissue Normal"))),
        hit("f4", case("c5", "Q", ("s6", "Solid Tissue Normal"))),
    ]
    put(tmp_path / "lines.json", "\n".join(map(json.dumps, hits)))
    put(tmp_path / "page.json", json.dumps({"data": {"hits": hits}}))
    for name in ("lines", "page"):
        rows = manifest.flatten_manifest(manifest.read_manifest(spark, str(tmp_path / f"{name}.json"))).orderBy("file_id").collect()
        assert [(r.file_id, r.project, r.case_submitter_id, r.sample_submitter_id, r.sample_type) for r in rows] == [
            ("f1", "P", "c1;c2", "s1;s2", "Primary Tumor"), ("f4", "Q", "c5", "s6", "Solid Tissue Normal"),
        ]


def test_features(spark, matrix, tmp_path):
    m = matrix(["g1", "g2"], {"a": [0.1, 2], "b": [3, 4]})
    features.export_features(m, str(tmp_path / "f"))
    for precision, kind in (("float32", np.float32), ("float64", float)):
        x, genes = features.read_features(spark, str(tmp_path / "f"), precision)
        assert genes == ("g1", "g2")
        assert {r["sample"]: r.x for r in x.collect()} == {"a": [float(kind(0.1)), 2.0], "b": [3.0, 4.0]}
    features.feature_rows(m, "float64", "other").write.mode("append").parquet(str(tmp_path / "f/float64"))
    with pytest.raises(ValueError, match="mixed_generations"):
        features.read_features(spark, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="non_finite"):
        features.export_features(matrix(["g"], {"a": [math.nan]}), str(tmp_path / "x"))


def test_expression_long_of_text(matrix):
    m = matrix(["g1"], {"a": ["x"], "b": ["2"]})
    assert m.long().where(F.col("value").isNotNull()).count() == 1


@pytest.mark.parametrize("second", ["sample,g2,g1\nb,3,4\n", "b,3,4\n"])
def test_parts_with_another_header_are_refused(spark, tmp_path, second):
    """No part's first line is dropped unread, nor are its columns swapped."""
    folder = tmp_path / "m.csv"
    folder.mkdir()
    put(folder / "a.csv", "sample,g1,g2\na,1,2\n")
    put(folder / "b.csv", second)
    with pytest.raises(Exception, match="(?i)header"):
        mx.read_matrix(spark, str(folder)).rows.collect()
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, str(folder), ["sample", "g1", "g2"]).collect()


@pytest.mark.parametrize("row", ["a,1", "a,1,2,99"])
def test_rows_of_another_width_are_refused(spark, tmp_path, row):
    p = put(tmp_path / "m.csv", f"sample,g1,g2\n{row}\n")
    with pytest.raises(Exception, match="fields"):
        mx.read_matrix(spark, p).rows.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, p, ["sample", "g1", "g2"]).collect()


def test_snapshot_modes(spark, tmp_path):
    put(tmp_path / "x.csv", "a\n")
    kinds = {m: tables.input_snapshot(spark, [str(tmp_path)], m).first().fingerprint for m in ("content", "stat")}
    assert len(kinds["content"]) == 64 and kinds["stat"].startswith("stat:")


def test_count_files_in_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"f{i}"
        folder.mkdir()
        (folder / f"s{i}.tsv").write_text(f"gene_id\ttpm_unstranded\nENSG1.2\t{i}\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "count files")
    try:
        assert counts.count_file_lines(spark, str(tmp_path)).count() == 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == old


def test_provider_files_hold_the_whole_text_of_each_row(spark, tmp_path):
    import glob

    from cohortloom.plans import fixtures as fx

    rows = [(f"id-{i}", f"# é\ngene_id\ttpm_unstranded\n\nENSG1\t{i}") for i in range(150)]
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        texts = spark.createDataFrame(rows, "file string, value string")
        fx.write_files(texts, path)
        fx.write_files(texts, path)  # as when a task runs twice
        found = {p.rsplit("file=", 1)[1]: open(p, encoding="utf-8", newline="").read() for p in glob.glob(path.removeprefix("file://") + "/*/*")}
        assert found == {f"{k}.tsv": v + "\n" for k, v in rows}
        got = {(r.file_id, r.value) for r in counts.read_count_files(spark, path, ["ENSG1"], fx.FILE_ID).selectExpr("file_id", "round(pow(2, value) - 1) as value").collect()}
        assert got == {(f"id-{i}", float(i)) for i in range(150)}
