import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import calibrate, checks, metrics, ranking


def brute_auc(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    p, n = s[y == 1], s[y == 0]
    if not len(p) or not len(n):
        return None
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def brute_ap(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    if not y.sum():
        return None
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        called = s >= t
        recall = (y[called] == 1).sum() / y.sum()
        total += (recall - last) * (y[called] == 1).mean()
        last = recall
    return total


def brute_youden(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    best = None
    for t in sorted({*s.tolist(), 0.0, 1.0}):
        c = s >= t
        key = ((c & (y == 1)).sum() / (y == 1).sum() + (~c & (y == 0)).sum() / (y == 0).sum() - 1, (c == (y == 1)).mean(), -t)
        if best is None or key > best[0]:
            best = (key, t)
    return best[1]


@pytest.mark.parametrize("n", [2, 3, 7, 25, 100])
def test_random_scores_against_brute_force(labelled, n):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 2, n)
    y[:2] = [0, 1]
    s = np.round(rng.random(n), 1)
    df = labelled(y.tolist(), s.tolist())
    r = metrics.classification_metrics(df, 0.5).head()
    assert r.auc == pytest.approx(brute_auc(y, s)) and r.average_precision == pytest.approx(brute_ap(y, s))
    assert metrics.youden_threshold(df).head().threshold == brute_youden(y, s)


def test_all_tied_scores_pick_one(labelled):
    r = metrics.youden_threshold(labelled([0, 0, 0, 1], [0.5] * 4)).head()
    assert (r.threshold, r.tn, r.fp, r.fn, r.tp) == (1.0, 3, 0, 1, 0)


def test_score_of_exactly_one(labelled):
    r = metrics.youden_threshold(labelled([0, 1, 1], [0.2, 1.0, 1.0])).head()
    assert (r.threshold, r.youden_j, r.tp, r.tn) == (1.0, 1.0, 2, 1)


def test_average_precision_groups_ties(labelled):
    y, s = [0, 1, 0, 1, 1, 0], [0.9, 0.9, 0.4, 0.4, 0.1, 0.1]
    assert ranking.average_precision(labelled(y, s)).head()[0] == pytest.approx(brute_ap(y, s))


@pytest.mark.parametrize("y", [[0, 0], [1, 1]])
def test_one_class(labelled, y):
    r = metrics.classification_metrics(labelled(y, [0.2, 0.8])).head()
    assert r.auc is None
    assert (r.average_precision is None) == (sum(y) == 0)
    assert r.balanced_accuracy == 0.5
    with pytest.raises(Exception, match="both classes"):
        metrics.youden_threshold(labelled(y, [0.2, 0.8])).collect()


@pytest.mark.parametrize(
    "y, s, problem",
    [([0, 2], [0.1, 0.2], "labels 0 and 1"), ([0, None], [0.1, 0.2], "labels 0 and 1"), ([0, 1], [0.1, math.nan], "finite"), ([0, 1], [0.1, None], "finite"), ([0, 1], [0.1, math.inf], "finite")],
)
@pytest.mark.parametrize(
    "metric",
    [
        ranking.roc_auc, ranking.average_precision, metrics.classification_metrics, metrics.youden_threshold, metrics.labelled_summary,
        lambda df: metrics.confusion_at(df, 0.5), lambda df: metrics.false_positive_rate(df, 0.5), lambda df: metrics.threshold_sweep(df, [("a", 0.5)]),
    ],
)
def test_bad_labels_and_scores_are_refused(spark, metric, y, s, problem):
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    with pytest.raises(Exception, match=problem):
        metric(df).collect()


def test_cutoffs_need_probabilities(labelled):
    with pytest.raises(Exception, match="probabilities"):
        metrics.youden_threshold(labelled([0, 1, 1], [-3.0, 0.5, 7.0])).collect()


@pytest.mark.parametrize("metric", [metrics.fpr_sweep, lambda df: metrics.all_normal_summary(df, score="score")])
def test_normal_cohorts_need_finite_scores(spark, metric):
    with pytest.raises(Exception, match="finite"):
        metric(spark.createDataFrame([(0.5,), (None,)], "score double")).collect()


@pytest.mark.parametrize("metric", [metrics.accuracy, metrics.balanced_accuracy, metrics.class_pairs])
@pytest.mark.parametrize("row", [(None, "a"), ("a", None)])
def test_missing_classes_are_refused(spark, metric, row):
    with pytest.raises(Exception, match="missing"):
        metric(spark.createDataFrame([("a", "a"), row], "t string, p string"), "t", "p").collect()


def skewed(spark, n=4000):
    """A third of all rows share one score, and scores crowd at 1."""
    i = F.col("id")
    score = F.when(i % 3 == 0, 0.999).otherwise(1 - 1 / (1 + (i * 7919) % 2003))
    return spark.range(n).select((F.xxhash64("id") % 2 == 0).cast("int").alias("label"), score.alias("score"), (i % 4 == 0).alias("g"))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_many_ranges_equal_one_range(spark, groups):
    hist = ranking.score_histogram(skewed(spark), "label", "score", groups)
    one = ranking.running_sums(hist, groups, "score", ["pos", "neg"])
    many = ranking.running_sums(hist, groups, "score", ["pos", "neg"], rows_per_range=37)
    key = lambda r: tuple(r.asDict().items())
    assert sorted(map(key, one.collect())) == sorted(map(key, many.select(one.columns).collect()))


def test_quantiles_by_group_match_numpy(spark):
    pdf = skewed(spark).toPandas()
    probs = [0, 0.1, 0.5, 0.95, 1]
    for r in ranking.exact_quantiles(skewed(spark), "score", probs, ["g"]).collect():
        want = np.quantile(pdf[pdf.g == r.g].score, probs)
        assert np.allclose(r.q, want, atol=1e-15)


def test_quantiles_skip_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (math.nan,), (None,)], "v double")
    assert ranking.exact_quantiles(df, "v", [0.5, 1]).head().q == [1.5, 2.0]


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_bracketed_quantiles_match_numpy(spark, accuracy):
    df = skewed(spark)
    v = df.toPandas().score
    probs = [0, 0.01, 0.33, 0.5, 0.99, 1]
    n, q = ranking.exact_cell_quantiles(df, "score", probs, accuracy)
    assert n == len(v) and np.allclose(q, np.quantile(v, probs), atol=1e-15)


def test_bracketed_quantiles_of_nothing(spark):
    assert ranking.exact_cell_quantiles(skewed(spark).where("false"), "score", [0, 0.5]) == (0, [None, None])


def test_hash_rank_is_a_permutation_in_hash_order(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") % 3 == 0).alias("g"))
    rows = ranking.hash_rank(df, "k", 9, ["g"]).collect()
    for g in (True, False):
        part = sorted((r for r in rows if r.g == g), key=lambda r: r.draw_rank)
        assert [r.draw_rank for r in part] == list(range(1, len(part) + 1))
        assert [r.draw_key for r in part] == sorted(r.draw_key for r in part)


def test_threshold_sweep_and_confusion(labelled):
    df = labelled([0, 0, 1, 1], [0.1, 0.6, 0.4, 0.9])
    rows = {r.threshold: (r.tn, r.fp, r.fn, r.tp) for r in metrics.threshold_sweep(df, [("a", 0.5), ("b", 0.4), ("c", 1.0)]).collect()}
    assert rows == {0.5: (1, 1, 1, 1), 0.4: (1, 1, 0, 2), 1.0: (2, 0, 2, 0)}
    assert tuple(metrics.confusion_at(df, 0.5).head()) == (1, 1, 1, 1)


def test_multiclass_tables(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    matrix = metrics.confusion_matrix(df, "t", "p")
    assert {(r.true_label, r.predicted_label): r.n for r in matrix.collect() if r.n} == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("c", "a"): 1}
    pairs = {r.label: tuple(r) for r in metrics.per_class_prf(metrics.class_pairs(df, "t", "p")).collect()}
    assert pairs == {r.label: tuple(r) for r in metrics.per_class_prf(matrix).collect()}
    prf = {r.label: (r.support, r.precision, r.recall, round(r.f1, 6)) for r in metrics.per_class_prf(matrix).collect()}
    assert prf == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 0.666667), "c": (1, 0.0, 0.0, 0.0)}
    assert metrics.accuracy(df, "t", "p").head()[0] == 0.5
    assert metrics.balanced_accuracy(df, "t", "p").head()[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, "t", "p", ["a", "a"])


def test_calibration_small_class_warning(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.8), ("d", 0.9)], "sample string, tumor_probability double")
    labels = spark.createDataFrame([("a", "normal"), ("b", "0"), ("c", "Tumour"), ("d", "1")], "sample string, label string")
    table, summary = calibrate.calibrate(scores, labels, [0.25])
    assert table.columns == list(checks.CONTRACTS["thresholds"])
    rows = {r.threshold_name: r for r in table.collect()}
    assert set(rows) == {"default", "youden_j", "threshold_0.25"}
    assert rows["youden_j"].threshold == 0.8 and rows["youden_j"].youden_j == 1.0 and rows["default"].youden_j is None
    s = summary.head()
    assert (s.n, s.n_tumor, s.n_normal, s.auc, s.recommended_threshold) == (4, 2, 2, 1.0, 0.8)
    assert len(s.warnings) == 1 and s.evaluation_type == "apparent_resubstitution"


def test_label_matching_guards(spark):
    scores = spark.createDataFrame([("001", 0.1), ("002", 0.9), ("003", 0.4)], "sample string, tumor_probability double")
    labels = spark.createDataFrame([("001", "normal"), ("002", "tumor"), ("1", "bogus")], "sample string, label string")
    with pytest.raises(ValueError, match="2 of 3"):
        calibrate.attach_labels(scores, labels)
    joined = calibrate.attach_labels(scores, labels, 0.5)
    assert {r["sample"]: r.label_binary for r in joined.collect()} == {"001": 0, "002": 1}
    with pytest.raises(ValueError, match="duplicate"):
        calibrate.attach_labels(scores.unionByName(scores), labels, 0.5)
    with pytest.raises(ValueError, match="both classes"):
        calibrate.attach_labels(scores, labels.where("label = 'tumor'"), 0.1)
    with pytest.raises(ValueError, match="out_of_range"):
        calibrate.attach_labels(scores.withColumn("tumor_probability", F.lit(1.5)), labels, 0.5)
    with pytest.raises(ValueError, match="unrecognized"):
        calibrate.attach_labels(scores, spark.createDataFrame([("001", "x"), ("002", "tumor")], labels.schema), 0.5)
    with pytest.raises(ValueError, match="unrecognized"):
        calibrate.reindex_labels(scores, labels)
    known = labels.withColumn("label", F.when(F.col("label") == "bogus", "normal").otherwise(F.col("label")))
    joined, stats = calibrate.reindex_labels(scores, known)
    assert tuple(stats.head()) == (3, 2, 1, 1) and joined.count() == 3
    with pytest.raises(ValueError, match="duplicate"):
        calibrate.reindex_labels(scores, known.unionByName(known))
    with pytest.raises(ValueError, match="duplicate"):
        calibrate.reindex_labels(scores.unionByName(scores), known)


def test_contracts(spark):
    good = spark.createDataFrame([("a", 0.5, "tumor")], "sample string, tumor_probability double, call string")
    checks.require(checks.contract_issues(good, "scores"), "scores")
    bad = spark.createDataFrame([(" a", 1.5, "cancer"), ("b", None, "normal"), ("b", 0.1, None)], good.schema)
    found = {(r.code, r.n) for r in checks.contract_issues(bad.select("call", "sample", "tumor_probability"), "scores").collect() if r.n}
    assert found == {("column_contract_mismatch", 1), ("padded", 1), ("duplicate", 1), ("non_numeric_probability", 1), ("probability_out_of_range", 1), ("invalid_call_value", 2)}


def test_score_consistency(spark):
    a = spark.createDataFrame([("a", 0.5, "tumor"), ("b", 0.2, "normal")], "sample string, tumor_probability double, call string")
    assert checks.score_consistency(a, a).head().consistent
    moved = a.withColumn("tumor_probability", F.col("tumor_probability") + 1e-5)
    assert not checks.score_consistency(a, moved).head().consistent
    assert not checks.score_consistency(a, a.where("sample = 'a'")).head().consistent


def test_metric_inputs(spark):
    df = spark.createDataFrame([(0.0, 0.1), (2.0, math.inf), (0.0, 0.3)], "y double, s double")
    got = {r.code: r.n for r in checks.metric_input_issues(df, "y", "s", True).collect()}
    assert got == {"empty": 0, "non_binary_label": 1, "non_finite_score": 1, "single_class": 1}
