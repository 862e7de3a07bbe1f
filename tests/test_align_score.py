import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import adapt, align, explain, model as M, score


def column(df, name, by="sample"):
    return {r[by]: r[name] for r in df.collect()}


def test_missing_gene_takes_training_mean(matrix):
    m = M.make_model(["g1", "g2", "g3"], [10, 20, 30], [1, 1, 1], [1, 1, 1], 0.0)
    a = align.align(matrix(["g1", "g3"], {"a": [1, 3], "b": [4, 6]}), m)
    assert column(a.rows.select("sample", a.imputed().alias("x")), "x") == {"a": [1, 20, 3], "b": [4, 20, 6]}
    assert (a.n_matched, a.positions) == (2, (0, -1, 1))


@pytest.mark.parametrize("header,genes", [(["ENSG1", "ENSG2"], ["ENSG2.5", "ENSG1.3"]), (["ENSG1.7", "ENSG2.1"], ["ENSG2", "ENSG1"])])
def test_versions_match_both_ways(header, genes):
    assert align.match_positions(header, genes) == [1, 0]


def test_exact_match_wins_and_collisions_are_refused():
    with pytest.raises(ValueError, match="differ only in version"):
        align.match_positions(["ENSG1.1", "ENSG1.2"], ["ENSG1.1"])
    with pytest.raises(ValueError, match="twice"):
        align.match_positions(["g", "g"], ["g"])


def test_report_counts_invalid_cells(matrix, spark):
    m = M.make_model(["g1", "g2", "g3"], [5, 6, 7], [1, 1, 1], [1, 1, 1], 0.0)
    x = matrix(["g1", "g2", "not_model"], {"s1": ["bad", "1", "0"], "s2": ["also_bad", "NaN", "0"]})
    r = align.alignment_report(align.align(x, m)).head()
    assert (r.n_samples, r.n_model_genes, r.n_matched_genes, r.n_missing_genes) == (2, 3, 2, 1)
    assert r.missing_genes == ["g3"]
    assert (r.matched_cells, r.invalid_matched_cells, r.invalid_matched_fraction) == (4, 3, 0.75)
    assert (r.n_genes_with_invalid_values, r.n_genes_with_all_invalid_values) == (2, 1)
    assert r.first_genes_with_all_invalid_values == ["g1"]
    assert (r.n_samples_with_invalid_values, r.n_samples_with_all_invalid_values) == (2, 1)
    assert r.first_samples_with_all_invalid_values == ["s2"]
    assert [(g.gene, g.invalid_cells, g.invalid_fraction) for g in r.first_genes_with_invalid_values] == [("g1", 2, 1.0), ("g2", 1, 0.5)]
    assert [(s["sample"], s.invalid_cells) for s in r.first_samples_with_invalid_values] == [("s1", 1), ("s2", 2)]
    assert r.max_invalid_matched_cell_fraction_per_sample == 1.0


def test_previews_stop_at_twenty(matrix):
    m = M.make_model(["g1", "g2"], [0, 0], [1, 1], [1, 1], 0.0)
    x = matrix(["g1", "g2"], {f"s{i:02d}": ["bad", "bad" if i % 2 else "1"] for i in range(60)})
    r = align.alignment_report(align.align(x, m)).head()
    assert [s["sample"] for s in r.first_samples_with_invalid_values] == [f"s{i:02d}" for i in range(20)]
    assert r.first_samples_with_all_invalid_values == [f"s{i:02d}" for i in range(1, 40, 2)]


def test_non_finite_cells_are_invalid(matrix):
    m = M.make_model(["g1"], [7], [1], [1], 0.0)
    x = matrix(["g1"], {"a": [1], "b": [math.inf], "c": [-math.inf], "d": [math.nan]})
    a = align.align(x, m)
    assert column(a.rows.select("sample", a.imputed().alias("x")), "x") == {"a": [1], "b": [7], "c": [7], "d": [7]}
    with pytest.raises(ValueError, match="invalid cells"):
        score.predict_proba(m, x)


def test_fraction_limits(matrix, spark):
    m = M.make_model(["g1", "g2"], [0, 0], [1, 1], [1, 1], 0.0)
    x = matrix(["g1", "g2"], {"a": ["bad", "1"], "b": ["1", "1"]})
    a = align.align(x, m)
    codes = lambda limit: {r.code for r in align.alignment_issues(align.alignment_report(a), limit).collect()}
    assert codes(0.0) == {"invalid_fraction", "worst_sample_fraction"}
    assert codes(0.3) == {"worst_sample_fraction"}
    assert codes(0.5) == set()
    assert score.predict_proba(m, x, max_invalid_fraction=0.5).count() == 2


def test_gene_coverage_guard(matrix):
    m = M.make_model(["a", "b", "c", "d"], [0] * 4, [1] * 4, [1] * 4, 0.0)
    one, two = matrix(["a"], {"s": [1]}), matrix(["a", "b"], {"s": [1, 1]})
    with pytest.raises(ValueError, match="gene coverage"):
        score.predict_proba(m, one)
    assert score.predict_proba(m, two).count() == 1
    assert score.predict_proba(m, one, allow_low_coverage=True).count() == 1
    report = align.alignment_report(align.align(matrix(["z"], {"s": [1]}), m))
    assert [r.code for r in align.gene_match_issues(report).collect()] == ["no_model_genes_matched"]


def test_call_follows_unrounded_probability(matrix):
    m = M.make_model(["g1"], [0], [1], [1], 0.0)
    low = math.log(0.4999995 / 0.5000005)
    x = matrix(["g1"], {"edge": [low], "high": [10.0]})
    exact = score.score_binary(m, x)
    assert column(exact, "call") == {"edge": "normal", "high": "tumor"}
    assert column(exact, "tumor_probability")["edge"] == pytest.approx(0.4999995, abs=1e-12)
    shown = score.score_binary(m, x, round_digits=6)
    assert column(shown, "tumor_probability")["edge"] == 0.5 and column(shown, "call")["edge"] == "tumor"


def test_class_order_is_checked(matrix):
    wrong = M.make_model(["g1"], [0], [1], [1], 0.0, ("tumor", "normal"))
    with pytest.raises(ValueError, match="normal, tumor"):
        score.score_binary(wrong, matrix(["g1"], {"a": [1]}))
    assert M.require_tumor_model(M.make_model(["g1"], [0], [1], [1], 0.0, ("0", "1.0")))


def test_overflowing_logit_is_an_error(matrix):
    m = M.make_model(["g1"], [0], [1e-300], [1e300], 0.0)
    with pytest.raises(Exception, match="non-finite"):
        score.predict_proba(m, matrix(["g1"], {"a": [1e10]})).collect()


def test_scores_match_numpy(matrix):
    rng = np.random.default_rng(5)
    n, g, k = 30, 12, 4
    x, mean, scale = rng.normal(5, 2, (n, g)), rng.normal(5, 1, g), rng.uniform(0.5, 2, g)
    coef, cut = rng.normal(size=(k, g)), rng.normal(size=k)
    genes = [f"g{i}" for i in range(g)]
    m = M.make_model(genes, mean.tolist(), scale.tolist(), coef.tolist(), cut.tolist(), [f"c{i}" for i in range(k)])
    data = matrix(genes, {f"s{i:02d}": row.tolist() for i, row in enumerate(x)})
    for mode in score.MODES:
        mu = mean if mode == "none" else x.mean(0)
        sd = x.std(0) if mode == "cohort_zscore" else scale
        logits = (x - mu) / sd @ coef.T + cut
        e = np.exp(logits - logits.max(1, keepdims=True))
        want = e / e.sum(1, keepdims=True)
        got = column(score.predict_proba(m, data, mode=mode), "probability")
        assert np.allclose([got[f"s{i:02d}"] for i in range(n)], want, atol=1e-12)
        if mode == "none":
            labels = column(score.predict(m, data), "predicted")
            assert [labels[f"s{i:02d}"] for i in range(n)] == [f"c{j}" for j in want.argmax(1)]


def test_top_classes_keep_class_order_on_ties(matrix):
    m = M.make_model(["g"], [0], [1], [[1.0], [1.0], [0.0]], [0.0, 0.0, 0.0], ["B", "A", "C"])
    r = score.predict_cancer_type(m, matrix(["g"], {"s": [2.0]}), 5).head()
    assert r.predicted_type == "B" and r.top1.startswith("B:0.4") and r.top2.startswith("A:0.4") and r.top3.startswith("C:")


def test_small_cohort_is_refused(matrix):
    m = M.make_model(["g1"], [0], [1], [1], 0.0)
    few = matrix(["g1"], {"a": [1], "b": [2]})
    with pytest.raises(ValueError, match="20 samples"):
        adapt.cohort_adapt_score(m, few, "cohort_zscore")
    assert adapt.cohort_adapt_score(m, few, "none").count() == 2
    x = np.linspace(-2, 2, 20)
    enough = matrix(["g1"], {f"s{i:02d}": [v] for i, v in enumerate(x)})
    p = column(adapt.cohort_adapt_score(m, enough, "cohort_zscore"), "tumor_probability")
    z = (x - x.mean()) / x.std()
    assert np.allclose([p[f"s{i:02d}"] for i in range(20)], 1 / (1 + np.exp(-z)))


def test_explanation_signs(matrix):
    m = M.make_model(["g1", "g2"], [0, 0], [1, 1], [1, 2], 0.0)
    rows = explain.explain(m, matrix(["g1", "g2"], {"up": [1, 1], "down": [-1, -1]}), 5).collect()
    got = {(r["sample"], r.direction, r["rank"]): (r.gene_id, r.contribution_logit) for r in rows}
    assert got == {
        ("up", "tumor", 1): ("g2", 2.0), ("up", "tumor", 2): ("g1", 1.0),
        ("down", "normal", 1): ("g2", -2.0), ("down", "normal", 2): ("g1", -1.0),
    }


def test_explanation_ties_go_by_gene_and_names_fall_back(matrix, spark):
    m = M.make_model(["ENSG2.1", "ENSG1.4"], [0, 0], [1, 1], [1, 1], 0.0)
    meta = spark.createDataFrame([("ENSG1.9", "ENSG1", "ONE"), ("ENSG2.1", "ENSG2", "TWO")], "gene_id string, gene_id_base string, gene_name string")
    rows = explain.explain(m, matrix(["ENSG1", "ENSG2"], {"s": [3, 3]}), 2, meta).orderBy("rank").collect()
    assert [(r.gene_id, r.gene_name) for r in rows] == [("ENSG1.4", "ONE"), ("ENSG2.1", "TWO")]
    clash = meta.unionByName(spark.createDataFrame([("ENSG1.9", "ENSG1", "UNO")], meta.schema))
    with pytest.raises(ValueError, match="conflicting_name"):
        explain.explain(m, matrix(["ENSG1", "ENSG2"], {"s": [3, 3]}), 2, clash)


def test_scoring_has_no_shuffle(matrix, tiny_model, spark):
    a = align.align(matrix(["g1", "g2"], {"a": [1, 2]}), tiny_model)
    for df in (score.score_aligned(a), explain.top_contributions(a, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_composition_bootstrap_matches_numpy(matrix):
    """Recompute the batches from the same draws in NumPy."""
    rng = np.random.default_rng(2)
    genes = ["a", "b", "c"]
    y = [i % 2 for i in range(40)]
    x = rng.normal(size=(40, 3)) + np.array(y)[:, None]
    m = M.make_model(genes, [0.5] * 3, [1.0] * 3, [1.0, 0.5, -0.2], 0.0)
    data = matrix(genes, {f"s{i:02d}": r.tolist() for i, r in enumerate(x)})
    labels = {f"s{i:02d}": v for i, v in enumerate(y)}
    rows = data.rows.withColumn("label", F.element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), F.col("sample")))
    a = align.align(type(data)(rows, data.genes), m, keep=["label"])
    got = adapt.composition_bootstrap(a, fractions=(0.25, 0.5), reps=4, n=8, seed=3).collect()

    from cohortloom.operators.ranking import hash_rank

    spark = rows.sparkSession
    order = {(r.label, r.draw_rank - 1): r["sample"] for r in hash_rank(rows.select("sample", "label"), "sample", 3, ["label"]).collect()}
    plan = adapt.draw_plan(spark, (0.25, 0.5), 4, 8).collect()
    at = lambda q: int(hashlib.md5(f"3:{q.fraction}:{q.rep}:{q.draw}".encode()).hexdigest()[:12], 16) % 20
    for r in got:
        base, da, auc = [], [], []
        for rep in range(4):
            batch = [q for q in plan if q.fraction == r.tumor_fraction and q.rep == rep]
            assert len(batch) == 8 and sum(q.label for q in batch) == round(8 * r.tumor_fraction)
            xs = np.array([x[int(order[q.label, at(q)][1:])] for q in batch])
            ys = np.array([q.label for q in batch])
            sd = xs.std(0)
            sd[sd == 0] = 1
            for z, out in (((xs - 0.5), base), ((xs - xs.mean(0)) / sd, da)):
                called = z @ np.array([1.0, 0.5, -0.2]) >= 0
                out.append((called[ys == 1].mean() + (~called[ys == 0]).mean()) / 2)
            s = ((xs - xs.mean(0)) / sd) @ np.array([1.0, 0.5, -0.2])
            pairs = [(p > q) + 0.5 * (abs(p - q) < 1e-12) for p in s[ys == 1] for q in s[ys == 0]]
            auc.append(np.mean(pairs))
        assert r.balanced_acc_deployed == pytest.approx(np.mean(base), abs=1e-4)
        assert r.balanced_acc_adapted == pytest.approx(np.mean(da), abs=1e-4)
        assert r.auc_adapted == pytest.approx(np.mean(auc), abs=2e-2)
