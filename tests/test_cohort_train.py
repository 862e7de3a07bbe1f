import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import checks, cohort, model as M, qc, splits, train
from cohortloom.operators.align import align
from cohortloom.operators.workflow import run_workflow

MANIFEST = "file_id string, sample_submitter_id string, case_submitter_id string, sample_type string, project string, file_name string, file_size bigint, md5sum string, n_sample_types int"


def uuid(i):
    return f"00000000-0000-0000-0000-{i:012d}"


@pytest.fixture(scope="module")
def provider(spark):
    t, n = "Primary Tumor", "Solid Tissue Normal"
    rows = [("b1", "c1", t), ("b1", "c1", t), ("b2", "c2", t), ("b3", "c1", n), ("b4", "c4", n), ("b5", "c5", n)]
    return spark.createDataFrame([(uuid(i), b, c, s, "P", "f", 10, "a" * 32, 1) for i, (b, c, s) in enumerate(rows)], MANIFEST)


def test_sample_per_class_is_donor_disjoint(provider):
    rows = cohort.sample_per_class(provider, 10, 1).collect()
    assert sorted((r.case_submitter_id, r.label) for r in rows) == [("c1", 1), ("c2", 1), ("c4", 0), ("c5", 0)]
    assert uuid(1) not in {r.file_id for r in rows}
    both = cohort.sample_per_class(provider, 10, 1, disjoint=False).collect()
    assert ("c1", 0) in {(r.case_submitter_id, r.label) for r in both}
    again = cohort.sample_per_class(provider, 1, 1).collect()
    assert again == cohort.sample_per_class(provider.repartition(3), 1, 1).collect()
    with pytest.raises(ValueError):
        cohort.sample_per_class(provider, 0, 1)
    with pytest.raises(ValueError, match="Solid Tissue Normal"):
        cohort.sample_per_class(provider.where("sample_type = 'Primary Tumor'"), 1, 1)


def test_project_draw_checks_the_manifest(provider):
    other = provider.withColumn("project", F.lit("Q")).withColumn("file_id", F.regexp_replace("file_id", "^00000000", "10000000"))
    both = provider.unionByName(other)
    assert {r.project for r in cohort.draw_project_files(both, "P", 10, 1).collect()} == {"P"}
    with pytest.raises(ValueError, match="no 'Primary Tumor' rows"):
        cohort.draw_project_files(both, "R", 10, 1)
    with pytest.raises(ValueError, match="invalid_md5"):
        cohort.draw_project_files(both.withColumn("md5sum", F.lit("x")), "P", 10, 1)
    with pytest.raises(ValueError, match="duplicate"):
        cohort.draw_project_files(provider.unionByName(provider), "P", 10, 1)


def test_study_draw(spark):
    rows = [("TCGA-A-1-01", "TCGA", "Primary Tumor"), ("TCGA-A-1-11", "TCGA", "Solid Tissue Normal"), ("TCGA-A-2-11", "TCGA", "Solid Tissue Normal"), ("GTEX-A-1", "GTEX", "Solid Tissue Normal")]
    df = spark.createDataFrame(rows, "sample string, study string, sample_type string")
    assert {r["sample"] for r in cohort.draw_study_samples(df, "TCGA", 5, 1).collect()} == {"TCGA-A-1-01", "TCGA-A-2-11"}
    with pytest.raises(ValueError, match="Primary Tumor"):
        cohort.draw_study_samples(df, "GTEX", 5, 1)
    with pytest.raises(ValueError, match="duplicate"):
        cohort.draw_study_samples(df.unionByName(df), "TCGA", 5, 1)


def test_manifest_rules(provider):
    unique = provider.where(F.col("file_id") != uuid(1))
    checks.require(cohort.provider_manifest_issues(unique, "P"), "manifest")
    for column, value, code in [
        ("md5sum", "x", "invalid_md5"), ("file_size", "0", "invalid_file_size"), ("sample_type", "Metastatic", "unsupported_sample_type"),
        ("case_submitter_id", "a;b", "several_cases"), ("project", "Q", "other_project"), ("file_id", "zz", "invalid_file_id"), ("n_sample_types", "2", "several_sample_types"),
    ]:
        first = F.col("file_id") == uuid(0)
        kind = dict(unique.dtypes)[column]
        bad = unique.withColumn(column, F.when(first, F.lit(value).cast(kind)).otherwise(F.col(column)))
        with pytest.raises(ValueError, match=code):
            checks.require(cohort.provider_manifest_issues(bad, "P"), "manifest")
    with pytest.raises(ValueError, match="label_disagrees"):
        checks.require(cohort.provider_manifest_issues(unique.withColumn("label", F.lit(1)), "P"), "manifest")
    with pytest.raises(ValueError, match="single_class"):
        checks.require(cohort.provider_manifest_issues(unique.where("sample_type = 'Primary Tumor'"), "P"), "manifest")


def test_sample_per_site(spark):
    rows = [(f"GTEX-{d}-{s}", "GTEX", "Normal Tissue", s) for s, donors in (("rare", range(3)), ("big", range(20)), ("tiny", range(1))) for d in donors]
    p = spark.createDataFrame(rows, "sample string, study string, sample_type string, primary_site string")
    drawn = cohort.sample_per_site(p, 5, 3, 1).collect()
    donors = [r.donor_id for r in drawn]
    assert len(set(donors)) == len(donors) == 8
    assert sum(r.primary_site == "rare" for r in drawn) == 3 and not any(r.primary_site == "tiny" for r in drawn)
    clash = p.where("primary_site = 'rare'").unionByName(p.where("primary_site = 'rare'").withColumn("primary_site", F.lit("rare2")).withColumn("sample", F.concat("sample", F.lit("b"))))
    with pytest.raises(ValueError, match="unused donors"):
        cohort.sample_per_site(clash, 5, 3, 1)
    assert cohort.sample_per_site_overlapping(clash, 5, 3, 1).count() == 6


def test_class_cap(spark):
    rows = [("A", 1, f"a{i}") for i in range(9)] + [("A", 0, f"n{i}") for i in range(2)] + [("B", 1, "b0")] + [("C", 0, "c0"), ("C", 1, "c1")]
    df = spark.createDataFrame(rows, "project string, label int, sample string")
    got = {(r.project, r.label): r["count"] for r in cohort.class_cap(df, 2).groupBy("project", "label").count().collect()}
    assert got == {("A", 1): 4, ("A", 0): 2, ("C", 0): 1, ("C", 1): 1}


def test_audits_and_merge(spark):
    df = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", " "), ("e", None)], "id string, donor string")
    assert tuple(cohort.group_audit(df, "id", "donor").head()) == (4, 4, 1, 1, 2)
    assert tuple(cohort.group_audit(df, "id", "absent").head()) == (4, 4, None, None, None)
    m = spark.createDataFrame([("a",), ("b",)], "sample string")
    s = spark.createDataFrame([("a", 0.1, "normal")], "sample string, tumor_probability double, call string")
    with pytest.raises(ValueError, match="without a score"):
        cohort.require_complete(m, cohort.attach_scores(m, s), "merge")


def synthetic(spark, n=48, genes=6, seed=0):
    """Three projects, gene 0 shifted by class, gene 1 by project."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y, p = i % 2, i % 3
        x = rng.normal(size=genes)
        x[0] += 2 * y
        x[1] += 2 * p
        rows.append((f"s{i:03d}", y, f"TCGA-{'ABC'[p]}", f"case{i // 6 * 3 + p}", x.tolist()))
    return spark.createDataFrame(rows, "sample string, y int, project string, case_id string, x array<double>")


GENES = [f"g{i}" for i in range(6)]


def test_anova_against_numpy(spark):
    df = synthetic(spark)
    pdf = df.toPandas()
    x = np.vstack(pdf.x)
    got = {r.pos: r.f for r in train.anova_f(df, "project").collect()}
    groups = [x[(pdf.project == p).to_numpy()] for p in sorted(set(pdf.project))]
    ssb = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups) / 2
    ssw = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(x) - 3)
    assert np.allclose([got[i] for i in range(6)], ssb / ssw)


def test_constant_genes_rank_first_or_last(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 0.1]), (0, [1.0, 5.0, 0.2]), (1, [2.0, 5.0, 0.3]), (1, [2.0, 5.0, 0.1])], "y int, x array<double>")
    f = train.anova_f(df)
    assert [r.pos for r in train.select_k_best(f, 1).collect()] == [0]
    assert [r.pos for r in train.select_k_best(f, 2).collect()] == [0, 2]


def test_merged_moments_equal_direct(spark):
    df = synthetic(spark)
    merged = train.merge_moments(train.class_moments(df, "y", ["project"]).where("project <> 'TCGA-A'"))
    direct = train.class_moments(df.where("project <> 'TCGA-A'"), "y")
    a = {(r.pos, r.y): (r.n, r["mean"], r["var"]) for r in merged.collect()}
    b = {(r.pos, r.y): (r.n, r["mean"], r["var"]) for r in direct.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def newton(z, y, w, c, steps=60):
    """Exact minimum of C * sum(w * loss) + |b|^2 / 2 with a free intercept."""
    a = np.column_stack([z, np.ones(len(z))])
    pen = np.r_[np.ones(z.shape[1]), 0]
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        grad = c * a.T @ (w * (p - y)) + pen * b
        hess = c * (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pen)
        b -= np.linalg.solve(hess, grad)
    return b


def test_fit_binary_is_the_exact_minimum(spark):
    df = synthetic(spark).where("sample < 's040'")
    pdf = df.toPandas()
    x, y = np.vstack(pdf.x), pdf.y.to_numpy()
    fitted = train.fit_binary(df, GENES, 3, 0.1)
    sel = list(fitted.positions)
    assert 0 in sel and sel == sorted(sel)
    z = (x[:, sel] - x[:, sel].mean(0)) / x[:, sel].std(0)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    b = newton(z, y, w, 0.1)
    assert np.allclose(fitted.model.coef[0], b[:-1], atol=1e-4) and abs(fitted.model.intercept[0] - b[-1]) < 1e-4
    assert np.allclose(fitted.model.mean, x[:, sel].mean(0)) and np.allclose(fitted.model.scale, x[:, sel].std(0))
    with pytest.raises(ValueError):
        train.fit_binary(df, GENES, 7)
    with pytest.raises(ValueError):
        train.fit_binary(df.where("y = 1"), GENES, 2)


def test_fit_multiclass_meets_the_optimality_conditions(spark):
    df = synthetic(spark)
    pdf = df.toPandas()
    fitted = train.fit_multiclass(df, GENES, 4, 2.0, "project")
    x = np.vstack(pdf.x)[:, list(fitted.positions)]
    z = (x - x.mean(0)) / x.std(0)
    coef, cut = np.array(fitted.model.coef), np.array(fitted.model.intercept)
    e = np.exp(z @ coef.T + cut)
    p = e / e.sum(1, keepdims=True)
    onehot = (pdf.project.to_numpy()[:, None] == np.array(fitted.model.classes)).astype(float)
    grad = 2.0 * (p - onehot).T @ z + coef
    assert np.abs(grad).max() < 1e-2 and np.abs((p - onehot).sum(0)).max() < 1e-2


@pytest.mark.slow
def test_grouped_cv_and_oof(spark):
    df = synthetic(spark, 90)
    cv = train.grouped_cv(df, GENES, 3, 0.1, n_folds=3).collect()
    assert [r.fold for r in cv] == [1, 2, 3] and sum(r.n_validation for r in cv) == 90
    assert all(r.n_train + r.n_validation == 90 and r.auc > 0.7 for r in cv)
    oof = train.oof_predictions(df, GENES, 3, 2.0, n_folds=3, y="project").collect()
    assert len({r["sample"] for r in oof}) == len(oof) == 90
    folds = {}
    for r in oof:
        folds.setdefault(r.case_id, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    assert np.mean([r.correct for r in oof]) > 0.6


@pytest.mark.slow
def test_loco_covers_every_sample_once(spark):
    df = synthetic(spark, 60)
    r = train.loco(df, GENES, 3, 0.1)
    per = r["per_type"].collect()
    assert [p.held_out_type for p in per] == ["TCGA-A", "TCGA-B", "TCGA-C"] and sum(p.n_test for p in per) == 60
    # The same fit by hand, on the other two types.
    alone = train.fit_binary(df.where("project <> 'TCGA-B'"), GENES, 3, 0.1)
    want = {q["sample"]: q.tumor_probability for q in train.predictions(alone, df.where("project = 'TCGA-B'")).collect()}
    got = {q["sample"]: q.tumor_probability for q in r["predictions"].where("held_out_type = 'TCGA-B'").collect()}
    assert want.keys() == got.keys() and all(abs(want[s] - got[s]) < 1e-4 for s in want)
    pooled = r["pooled"].head()
    assert pooled.macro_min_auc <= pooled.macro_mean_auc
    with pytest.raises(ValueError, match="held out"):
        train.loco(df.withColumn("case_id", F.lit("same")), GENES, 3, 0.1)


def test_folds_are_balanced_and_disjoint(spark):
    df = synthetic(spark, 600)
    folds = splits.grouped_stratified_folds(df, 5, 1, "case_id", ["project", "y"])
    assert folds.count() == folds.select("case_id").distinct().count() == df.select("case_id").distinct().count()
    sizes = [r["count"] for r in splits.with_folds(df, folds).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 12


def test_split_checks(spark):
    df = synthetic(spark)
    checks.require(splits.split_issues(df.withColumnRenamed("y", "label"), df.where("sample < 's024'"), df.where("sample >= 's024'")), "split")
    with pytest.raises(ValueError, match="leakage"):
        checks.require(splits.leakage_issues(df.where("y = 0"), df.where("y = 1"), ["case_id"]), "split")
    with pytest.raises(ValueError, match="not_unique"):
        checks.require(splits.dependency_issues(df.withColumn("v", F.col("y").cast("string")), "case_id", "v"), "dep")


def test_model_rules(spark, tiny_model):
    t = M.model_tables(spark, tiny_model)
    assert t.load() == tiny_model
    bad_scale = M.ModelTables(t.genes.withColumn("scale", F.lit(0.0)), t.coef, t.head, "binary")
    with pytest.raises(ValueError, match="non_positive_scale"):
        bad_scale.load()
    with pytest.raises(ValueError, match="shape_mismatch"):
        M.ModelTables(t.genes, t.coef.where("pos = 0"), t.head, "binary").load()
    with pytest.raises(ValueError, match="version_collision"):
        M.ModelTables(t.genes.withColumn("gene_id", F.concat(F.lit("E."), (F.col("pos") + 1).cast("string"))), t.coef, t.head, "binary").load()
    with pytest.raises(ValueError, match="kind_mismatch"):
        M.ModelTables(t.genes, t.coef, t.head, "multiclass").load()
    assert {r.part: r.max_abs_delta for r in M.compare_models(t, t).collect()} == {"mean": 0, "scale": 0, "coef": 0, "intercept": 0}


def test_qc_rules(matrix, tiny_model):
    good = {f"s{i:02d}": [np.sin(i), np.cos(i)] for i in range(25)}
    clean = {s: [abs(v) for v in c] for s, c in good.items()}
    r = qc.inspect(tiny_model, matrix(["g1", "g2"], clean))
    assert r["status"] == "PASS" and r["messages"] == []
    x = np.array(list(clean.values()))
    assert r["value_summary"]["p50"] == pytest.approx(np.median(x))
    assert r["distribution_summary"]["sample_p95_abs_z"]["p90"] == pytest.approx(np.quantile(np.percentile(np.abs(x), 95, axis=1), 0.9))
    assert r["distribution_summary"]["cohort_gene_mean_abs_z"]["max"] == pytest.approx(np.abs(x.mean(0)).max())

    def codes(rows, genes=("g1", "g2"), **kw):
        return [m["code"] for m in qc.inspect(tiny_model, matrix(genes, rows), **kw)["messages"]]

    assert codes({"a": [1]}, ["x"]) == ["no_model_genes_matched", "nonfinite_or_missing_values"]
    assert codes({"a": [1]}, ["g1"]) == ["low_model_gene_match", "nonfinite_or_missing_values"]
    assert codes(good)[0] == "negative_expression_values"
    thousand = codes({f"s{i}": [1000, 1000] for i in range(20)})
    assert thousand == ["expression_values_too_large", "expression_max_too_large", "many_extreme_standardized_values", "very_extreme_standardized_values", "cohort_distribution_shift", "large_cohort_gene_shift"]
    assert codes({f"s{i}": [5, 1] for i in range(4)}, expected_class="normal") == ["unexpected_tumor_calls"]
    assert codes({f"s{i}": [1, 5] for i in range(4)}, expected_class="tumor") == ["unexpected_normal_calls"]
    with pytest.raises(ValueError):
        qc.check_rules({"nope": 1})
    with pytest.raises(ValueError):
        qc.check_rules({"min_match_rate_fail": 0.99})


@pytest.mark.slow
def test_workflow_states(spark, matrix, tiny_model, tmp_path):
    rows = {f"s{i:02d}": [1 + i % 3, 1 + (i * 7) % 5] for i in range(24)}
    good = matrix(["g1", "g2"], rows)
    labels = spark.createDataFrame([(s, "tumor" if c[0] > c[1] else "normal") for s, c in rows.items()], "sample string, label string")
    out = str(tmp_path / "out")
    r = run_workflow(spark, tiny_model, good, out, labels, top_n=1).head()
    assert r.status == "complete" and r.outputs == "qc,scores,thresholds,calibration,explanations" and r.samples == 24
    scores = spark.read.csv(f"{out}/run={r.run_id}/scores", header=True)
    assert scores.count() == 24 and r.tumor_calls + r.normal_calls == 24
    r = run_workflow(spark, tiny_model, good, out, labels.limit(3)).head()
    assert r.status == "stopped_after_calibration_error" and r.outputs == "qc,scores" and "3 of 24" in r.error
    r = run_workflow(spark, tiny_model, matrix(["g1", "g2"], {**rows, "zz": [float("nan"), 1]}), out).head()
    assert r.status == "stopped_after_invalid_input" and r.outputs == "qc"
    r = run_workflow(spark, tiny_model, matrix(["x", "g2"], {"a": [1000, 1000]}), out).head()
    assert r.status == "stopped_after_qc_fail" and r.outputs == "qc" and r.qc_status == "FAIL"
    assert spark.read.parquet(f"{out}/manifest").count() == 4


def test_union_of_cohorts_fills_absent_genes(matrix, tiny_model):
    u = cohort.union_cohorts([matrix(["g1"], {"a": [1]}), matrix(["g2", "g1"], {"b": ["2", "x"]})])
    assert u.genes == ("g1", "g2")
    assert {r["sample"]: r.cells for r in u.rows.collect()} == {"a": [1.0, None], "b": [None, 2.0]}
    assert align(u, tiny_model).n_matched == 2


@pytest.fixture
def provider_files(spark, provider, tmp_path):
    """Count files of the provider's six files and of one that no manifest names."""
    for i in range(7):
        level = 3.0 if i < 3 else 1.0
        lines = ["gene_id\tgene_name\tgene_type\ttpm_unstranded", f"g1\ta\tb\t{level + i}", f"g2\ta\tb\t{4.0 - level}", "other\ta\tb\tx"]
        (tmp_path / f"{uuid(i)}.tsv").write_text("\n".join(lines) + "\n")
    manifest = provider.where(F.col("file_id") != uuid(1)).withColumn("sample_submitter_id", F.concat(F.lit("s"), F.substring("file_id", 36, 1)))
    return manifest, str(tmp_path)


def test_external_count_files(spark, provider_files, tiny_model):
    from cohortloom.operators import external

    manifest, path = provider_files
    found = external.validate_count_files(tiny_model, manifest, path)
    logit = {i: np.log2(1 + (3.0 if i < 3 else 1.0) + i) - np.log2(1 + 4.0 - (3.0 if i < 3 else 1.0)) for i in range(6)}
    got = {r.file_id: (r.label, r.tumor_probability) for r in found["predictions"].collect()}
    assert set(got) == {uuid(i) for i in (0, 2, 3, 4, 5)}
    for i in (0, 2, 3, 4, 5):
        assert got[uuid(i)][0] == (1 if i < 3 else 0) and abs(got[uuid(i)][1] - 1 / (1 + np.exp(-logit[i]))) < 1e-12
    audit = found["audit"].first()
    assert (audit.n_rows, audit.n_unique_groups, audit.n_repeated_groups, audit.n_unique_biospecimens, audit.cohort_mode) == (5, 4, 1, 5, "locked")
    assert found["summary"].first().n == 5 and found["alignment"].first().n_matched_genes == 2
    assert {r.sample_type: r.n for r in found["by_type"].collect()} == {"Primary Tumor": 2, "Solid Tissue Normal": 3}
    drawn = external.validate_count_files(tiny_model, manifest, path, project="P", n_per_class=1)
    assert drawn["audit"].first().cohort_mode == "sampled" and drawn["predictions"].count() == 2


def test_external_count_files_refuse_what_does_not_fit(spark, provider_files, tiny_model):
    from cohortloom.operators import external

    manifest, path = provider_files
    absent = manifest.unionByName(manifest.limit(1).withColumn("file_id", F.lit(uuid(9))).withColumn("sample_submitter_id", F.lit("s9")))
    with pytest.raises(ValueError, match="no_cells.*" + uuid(9)):
        external.validate_count_files(tiny_model, absent, path)
    with pytest.raises(ValueError, match="other_project"):
        external.validate_count_files(tiny_model, manifest, path, project="Q")
    with pytest.raises(ValueError, match="several_cases"):
        external.validate_count_files(tiny_model, manifest.withColumn("case_submitter_id", F.lit("a;b")), path)
    with pytest.raises(ValueError, match="needs a project"):
        external.validate_count_files(tiny_model, manifest, path, n_per_class=1)
    half = M.make_model(["g1", "g3", "g4"], [0.0] * 3, [1.0] * 3, [1.0] * 3, 0.0)
    with pytest.raises(ValueError, match="1 of 3"):
        external.validate_count_files(half, manifest, path)
    assert external.validate_count_files(half, manifest, path, allow_low_coverage=True)["predictions"].count() == 5


def test_external_gene_rows(spark, tiny_model, tmp_path):
    from cohortloom.operators import external

    names = ["GTEX-A-1", "GTEX-A-2", "GTEX-B-1", "GTEX-C-1", "GTEX-X-9"]
    lines = ["sample\t" + "\t".join(names)] + [g + "\t" + "\t".join(str(np.log2(v + k + 0.001)) for k in range(5)) for g, v in (("g1", 1.0), ("g2", 2.0), ("zz", 9.0))]
    (tmp_path / "genes.tsv").write_text("\n".join(lines) + "\n")
    rows = [(n, "GTEX", "Normal Tissue", s) for n, s in zip(names[:4], ("Lung", "Skin", "Lung", "Skin"))] + [("TCGA-1", "TCGA", "Primary Tumor", "Lung")]
    phenotype = spark.createDataFrame(rows, "sample string, study string, sample_type string, primary_site string")
    found = external.validate_gene_rows(tiny_model, phenotype, str(tmp_path / "genes.tsv"))
    got = {r["sample"]: r.tumor_probability for r in found["predictions"].collect()}
    want = {n: 1 / (1 + np.exp(-(np.log2(1.0 + k + 1) - np.log2(2.0 + k + 1)))) for k, n in enumerate(names[:4])}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    audit = found["audit"].first()
    assert (audit.n_rows, audit.n_unique_groups, audit.max_rows_per_group, audit.cohort_mode) == (4, 3, 2, "locked")
    assert {r.primary_site: r.n for r in found["by_site"].collect()} == {"Lung": 2, "Skin": 2}
    drawn = external.validate_gene_rows(tiny_model, phenotype, str(tmp_path / "genes.tsv"), n_per_site=1)
    donors = [r.donor_id for r in drawn["predictions"].collect()]
    assert len(donors) == len(set(donors)) == 2 and drawn["audit"].first().cohort_mode == "sampled"
    with pytest.raises(ValueError, match="missing_sample"):
        external.validate_gene_rows(tiny_model, phenotype.unionByName(phenotype.limit(1).withColumn("sample", F.lit("GTEX-Z-1"))), str(tmp_path / "genes.tsv"))


def test_gene_moments_of_groups_with_absent_cells(spark):
    from cohortloom.operators import moments

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) * [1.0, 1e-3, 1e6] + [0.0, 1e6, 1e9]
    x = np.column_stack([x, np.full(60, 0.1), np.full(60, np.nan)])
    gone = rng.random(x.shape) < 0.2
    gone[:, 3], gone[:, 4] = False, True
    groups = [None if i % 7 == 0 else "abc"[i % 3] for i in range(60)]
    data = [(g, [None if gone[i, j] else float(x[i, j]) for j in range(5)]) for i, g in enumerate(groups)] + [("a", None)]
    found = moments.gene_moments(spark.createDataFrame(data, "g string, x array<double>").repartition(5), ["g"])
    got = {(r.g, r.pos): (r.n, r["mean"], r["var"]) for r in found.collect()}
    assert len(got) == 4 * 5
    for g in (None, "a", "b", "c"):
        at = np.array([k == g for k in groups])
        for j in range(5):
            own = x[at & ~gone[:, j], j]
            n, mean, var = got[(g, j)]
            assert n == len(own)
            if not n:
                assert mean is None and var is None
            else:
                assert np.isclose(mean, own.mean(), rtol=1e-14) and np.isclose(var, own.var(), rtol=1e-6, atol=1e-25)
    assert {got[(g, 3)][2] for g in (None, "a", "b", "c")} == {0.0}
    assert moments.gene_moments(spark.createDataFrame([], "g string, x array<double>"), ["g"]).count() == 0
    with pytest.raises(Exception, match="different length"):
        moments.gene_moments(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "x array<double>").coalesce(1)).collect()


def test_moments_make_no_row_per_cell(spark, matrix, tiny_model):
    from cohortloom.operators import adapt

    df = synthetic(spark)
    a = align(matrix(["g1", "g2"], {"s1": [1.0, 2.0], "s2": [3.0, 5.0]}), tiny_model)
    for plan in (train.anova_f(df), train.training_scaler(df), adapt.cohort_gene_stats(a)):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("family, y", [("binomial", "y"), ("multinomial", "project")])
def test_joint_fits_equal_single_ones_and_are_optimal(spark, family, y):
    df = synthetic(spark, 120).withColumn("part", F.pmod(F.hash("case_id"), F.lit(3)))
    together = train.fit_sides(df, y, GENES, 3, 2.0, family, "part", [0, 1, 2])
    for p, fitted in together.items():
        rest = df.where(F.col("part") != p)
        alone = train.fit_sides(rest, y, GENES, 3, 2.0, family)[None]
        assert fitted.positions == alone.positions and fitted.residual <= 1e-9
        assert np.allclose(fitted.model.coef, alone.model.coef, atol=1e-8) and np.allclose(fitted.model.intercept, alone.model.intercept, atol=1e-8)
        told = train.optimality(fitted, rest, 2.0, y).collect()
        assert len(told) == 3 * len(fitted.model.coef) and max(abs(r.residual) for r in told) < 1e-9


def test_large_models_go_to_single_fits_with_the_same_result(spark, monkeypatch):
    df = synthetic(spark, 90)
    joint = train.fit_multiclass(df, GENES, 3, 1.0, "project")
    monkeypatch.setattr(train.newton, "HESSIAN_BYTES", 1)
    single = train.fit_multiclass(df, GENES, 3, 1.0, "project")
    assert single.residual is None and np.allclose(joint.model.coef, single.model.coef, atol=1e-4)
    assert np.allclose(joint.model.intercept, single.model.intercept, atol=1e-4)


def test_a_fit_that_separates_the_classes_and_one_cut_short(spark):
    rows = [(float(i), [float(i), float(i % 3)], int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "sample double, x array<double>, y int")
    fitted = train.fit_binary(df, ["a", "b"], 2, 1e6)
    assert fitted.residual < 1e-9 and fitted.model.coef[0][0] > 5
    with pytest.raises(RuntimeError, match="did not converge in 2"):
        train.fit_binary(df, ["a", "b"], 2, 1e6, max_iter=2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_draw_in_turns_equals_turn_by_turn(spark, seed):
    import hashlib
    import random

    rng = random.Random(seed)
    rows = [(f"k{i}", f"g{rng.randrange(8)}", f"d{rng.randrange(25)}") for i in range(160)]
    rows = list({(g, d): (k, g, d) for k, g, d in rows}.values())
    rank = lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k)
    want, used = set(), set()
    for g in sorted({g for _, g, _ in rows}):
        best = sorted((k for k, own, d in rows if own == g and d not in used), key=rank)[:4]
        want |= set(best)
        used |= {d for k, _, d in rows if k in best}
    pool = spark.createDataFrame(rows, "key string, grp string, donor string").repartition(3)
    found = cohort.draw_in_turns(pool, F.col("grp"), "grp", "donor", "key", 4, seed).collect()
    assert {r.key for r in found} == want and len({r.donor for r in found}) == len(found)


def test_jobs_of_a_site_draw_do_not_follow_the_sites(spark):
    def jobs(sites):
        rows = [(f"GTEX-{s}x{d}-{s}", "GTEX", "Normal Tissue", f"site{s:02d}") for s in range(sites) for d in range(4)]
        p = spark.createDataFrame(rows, "sample string, study string, sample_type string, primary_site string")
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        assert cohort.sample_per_site(p, 3, 2, 1).count() == 3 * sites
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before

    assert jobs(30) <= jobs(3) + 2


def test_genes_of_biotype_by_id_then_by_base(spark):
    genes = spark.createDataFrame([("A.1",), ("B.2",), ("C.1",), ("D.1",), ("E",), ("F.9",)], "gene_id string")
    told = [("A.1", "protein_coding"), ("A.2", "lncRNA"), ("B.7", "protein_coding"), ("C.1", "lncRNA"), ("C.5", "protein_coding"), ("D.2", None), ("E.4", "lncRNA"), ("E.5", "protein_coding")]
    found = cohort.genes_of_biotype(genes, spark.createDataFrame(told, "gene_id string, gene_type string"))
    assert sorted(r.gene_id for r in found.collect()) == ["A.1", "B.2", "E"]
    assert cohort.genes_of_biotype(genes, spark.createDataFrame([], "gene_id string, gene_type string")).count() == 0
