"""Joins with labels, ranking statistics, threshold metrics and cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, cohort, metrics, ranking
from . import fixtures as fx
from .common import rounded
from .registry import query

# Ranking pieces in SQL: hist(g, score, pos, neg) to running counts.
RANKS = """hist as (select g, score, count(*) filter (where label=1) as pos, count(*) filter (where label=0) as neg from src group by g, score),
ranks as (select *, coalesce(sum(pos) over (partition by g order by score rows between unbounded preceding and 1 preceding),0) as pos_before,
  coalesce(sum(neg) over (partition by g order by score rows between unbounded preceding and 1 preceding),0) as neg_before,
  sum(pos) over (partition by g) as p_all, sum(neg) over (partition by g) as n_all from hist),
auc as (select g, case when max(p_all*n_all)>0 then sum(pos*(neg_before+neg/2.0))/max(p_all*n_all) end as auc,
  case when max(p_all)>0 then sum(cast(pos as double)/p_all*((p_all-pos_before)/cast(p_all-pos_before+n_all-neg_before as double))) end as ap from ranks group by g),
cands as (select g, score as threshold, p_all-pos_before as tp, n_all-neg_before as fp, p_all, n_all from ranks
  union select distinct g, 0.0, p_all, n_all, p_all, n_all from ranks
  union select g, 1.0, sum(case when score>=1 then pos else 0 end), sum(case when score>=1 then neg else 0 end), max(p_all), max(n_all) from ranks group by g),
keyed as (select *, cast(tp as double)/p_all + cast(n_all-fp as double)/n_all - 1.0 as j, cast(tp+n_all-fp as double)/(p_all+n_all) as acc from cands where p_all>0 and n_all>0),
best as (select g, threshold, cast(n_all-fp as bigint) as tn, cast(fp as bigint) as fp, cast(p_all-tp as bigint) as fn, cast(tp as bigint) as tp, j as youden_j from
  (select *, row_number() over (partition by g order by j desc, acc desc, threshold) as rn from keyed) where rn=1)"""

SRC = "src as (select 0 as g, label, score from labelled)"

RATES = """case when tn+fp+fn+tp>0 then (tp+tn)/cast(tn+fp+fn+tp as double) else 0 end as accuracy,
 case when tp+fp>0 then tp/cast(tp+fp as double) else 0 end as precision,
 case when tp+fn>0 then tp/cast(tp+fn as double) else 0 end as recall,
 case when tn+fp>0 then tn/cast(tn+fp as double) else 0 end as specificity,
 case when 2*tp+fp+fn>0 then 2.0*tp/(2*tp+fp+fn) else 0 end as f1"""
R = "round(accuracy,6) as accuracy, round(precision,6) as precision, round(recall,6) as recall, round(specificity,6) as specificity, round(f1,6) as f1"


def labelled(spark, sf):
    return fx.labelled_scores(spark, sf)


# --- joins -----------------------------------------------------------------


@query(fx.with_views(fx.LABELLED, body="select sample, round(tumor_probability,6) as tumor_probability, y as label_binary from scores join label_table using (sample)"))
def attach_labels(spark, sf):
    return rounded(calibrate.attach_labels(fx.scores(spark, sf), fx.labels(spark, sf), min_match_fraction=0.1).select("sample", "tumor_probability", "label_binary"))


@query(
    fx.with_views(
        fx.LABELLED,
        body="""select count(s.sample) as n_scores, count(l.sample) as n_labels, count(*) filter (where s.sample is not null and l.sample is not null) as n_matched,
 count(*) filter (where l.sample is null) as n_unmatched, count(*) filter (where s.sample is null) as n_extra,
 round(count(*) filter (where s.sample is not null and l.sample is not null)/cast(count(s.sample) as double),6) as match_fraction
 from (select * from scores where lang<>'fr') s full outer join label_table l using (sample)""",
    )
)
def label_match_statistics(spark, sf):
    d = fx.table(spark, sf, "documents").where("lang <> 'fr'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample"))
    return rounded(calibrate.label_match(d, fx.labels(spark, sf)))


@query(fx.with_views(fx.LABELLED, body="select s.sample, round(tumor_probability,6) as tumor_probability, y as label_binary from scores s left join label_table l using (sample)"))
def reindex_labels(spark, sf):
    joined, _ = calibrate.reindex_labels(fx.scores(spark, sf), fx.labels(spark, sf))
    return rounded(joined.select("sample", "tumor_probability", "label_binary"))


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA,
        body="select 'metadata' as check_name, 'ERROR' as level, 'incomplete_'||c as code, (select count(*) from metadata where is_test) as n, '' as examples from (select unnest(['project','case_id']) as c)",
    )
)
def reindex_metadata(spark, sf):
    """Metadata of training samples only: every test sample is incomplete."""
    from ..operators import splits

    meta = fx.metadata(spark, sf).where("not is_test").select("sample", "project", "case_id")
    joined = splits.reindex_metadata(fx.expression(spark, sf).rows.select("sample"), meta)
    return splits.completeness_issues(joined, ["project", "case_id"])


@query(
    fx.with_views(
        fx.PHENOTYPE, fx.NORMALS,
        body="""select sample, primary_site, round(n.tumor_probability,6) as tumor_probability, case when n.tumor_probability>=0.5 then 'tumor' when n.tumor_probability is not null then 'normal' end as call
 from phenotype left join (select sample, tumor_probability from normals where primary_site<>'error') n using (sample)""",
    )
)
def attach_scores(spark, sf):
    s = fx.normal_scores(spark, sf).where("primary_site <> 'error'").select("sample", "tumor_probability", "call")
    return rounded(cohort.attach_scores(fx.phenotype(spark, sf), s).select("sample", "primary_site", "tumor_probability", "call"))


@query(
    fx.with_views(
        fx.NORMALS,
        body="""select count(*) as n_expected, count(*) as n_merged, count(*) filter (where primary_site='error') as n_unscored,
 count(*) filter (where primary_site='error')=0 as complete from normals""",
    )
)
def merge_completeness(spark, sf):
    p = fx.phenotype(spark, sf)
    s = fx.normal_scores(spark, sf).where("primary_site <> 'error'").select("sample", "tumor_probability", "call")
    return cohort.merge_completeness(p, cohort.attach_scores(p, s))


@query(
    fx.with_views(
        fx.MANIFEST,
        "used as (select distinct case_submitter_id from manifest where sample_type='Primary Tumor' and project='P-F')",
        body="select file_id, case_submitter_id from manifest where sample_type='Solid Tissue Normal' and case_submitter_id not in (select case_submitter_id from used)",
    )
)
def exclude_used(spark, sf):
    m = fx.file_manifest(spark, sf)
    used = m.where("sample_type = 'Primary Tumor' and project = 'P-F'")
    return cohort.exclude_used(m.where("sample_type = 'Solid Tissue Normal'"), used, "case_submitter_id").select("file_id", "case_submitter_id")


@query(
    fx.with_views(
        fx.MANIFEST,
        body="""select f as field, (select count(*) from manifest where o_orderkey%11=0) as n_missing,
 case f when 'md5sum' then (select count(*) from manifest where o_orderkey%11<>0 and o_orderkey%13=0) when 'file_size' then (select count(*) from manifest where o_orderkey%11<>0 and o_orderkey%17=0) else 0 end as n_changed
 from (select unnest(['project','md5sum','file_size']) as f)""",
    )
)
def compare_locked(spark, sf):
    """A provider that lost, re-hashed and resized some locked files."""
    k = F.col("o_orderkey")
    old = fx.file_manifest(spark, sf)
    o = fx.table(spark, sf, "orders")
    new = o.where(k % 11 != 0).select(
        fx.file_uuid("o_orderkey").alias("file_id"), F.concat(F.lit("P-"), F.col("o_orderstatus")).alias("project"),
        F.when(k % 13 == 0, F.md5(F.lit("x"))).otherwise(F.upper(F.md5(k.cast("string")))).alias("md5sum"),
        (k % 1000 + 1 + F.when(k % 17 == 0, 1).otherwise(0)).alias("file_size"),
    )
    return cohort.compare_locked(old, new, ["project", "md5sum", "file_size"], ignore_case=["md5sum"])


# --- ranking ---------------------------------------------------------------


@query(fx.with_views(fx.LABELLED, SRC, RANKS, body="select round(auc,6) as auc from auc"))
def roc_auc(spark, sf):
    return rounded(ranking.roc_auc(labelled(spark, sf)))


@query(fx.with_views(fx.LABELLED, "src as (select lang as g, label, score from labelled)", RANKS, body="select g as lang, round(auc,6) as auc, round(ap,6) as average_precision from auc"))
def ranking_by_group(spark, sf):
    return rounded(ranking.ranking_metrics(labelled(spark, sf), groups=["lang"]))


@query(
    fx.with_views(
        "src as (select 0 as g, l_linenumber%2 as label, round(l_extendedprice,1) as score from lineitem)", RANKS,
        body="select round(auc,6) as auc, round(ap,6) as average_precision from auc",
    )
)
def ranking_many_scores(spark, sf):
    """Line prices as scores: cut into many value ranges."""
    src = fx.table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("label"), F.round("l_extendedprice", 1).alias("score"))
    hist = ranking.score_histogram(src, "label", "score")
    ranks = ranking.running_sums(hist, [], "score", ["pos", "neg"], rows_per_range=5_000)
    return rounded(ranks.agg(ranking.auc_column().alias("auc"), ranking.average_precision_column().alias("average_precision")))


@query(fx.with_views(fx.LABELLED, SRC, RANKS, body="select round(ap,6) as average_precision from auc"))
def average_precision(spark, sf):
    return rounded(ranking.average_precision(labelled(spark, sf)))


YOUDEN = f"select round(threshold,6) as threshold, tn, fp, fn, tp, round(youden_j,6) as youden_j, {R} from (select *, {RATES} from best)"


@query(fx.with_views(fx.LABELLED, SRC, RANKS, body=YOUDEN))
def youden_threshold(spark, sf):
    return rounded(metrics.youden_threshold(labelled(spark, sf))).drop("sensitivity", "balanced_accuracy")


CONFUSION = """counts_ as (select count(*) filter (where score<{t} and label=0) as tn, count(*) filter (where score>={t} and label=0) as fp,
 count(*) filter (where score<{t} and label=1) as fn, count(*) filter (where score>={t} and label=1) as tp from labelled)"""


@query(fx.with_views(fx.LABELLED, CONFUSION.format(t=0.5), body="select * from counts_"))
def confusion_at(spark, sf):
    return metrics.confusion_at(labelled(spark, sf), 0.5)


@query(
    fx.with_views(
        fx.LABELLED, SRC, RANKS, CONFUSION.format(t=0.4),
        body=f"""select 0.4 as threshold, tn, fp, fn, tp, (select round(auc,6) from auc) as auc, (select round(ap,6) from auc) as average_precision, {R}, round(recall,6) as sensitivity,
 round((recall+specificity)/2,6) as balanced_accuracy from (select *, {RATES} from counts_)""",
    )
)
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(labelled(spark, sf), 0.4))


# Three-class prediction fixture: truth by priority, prediction by price.
PREDICTED = """preds as (select o_orderpriority as true_label, case when o_totalprice%5<1 then '1-URGENT' when o_totalprice%5<2 then '3-MEDIUM'
  when o_totalprice%5<3 then '9-OTHER' else o_orderpriority end as predicted_label, o_orderstatus from orders)"""


def class_predictions(spark, sf):
    p = F.col("o_totalprice") % 5
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("true_label"),
        F.when(p < 1, "1-URGENT").when(p < 2, "3-MEDIUM").when(p < 3, "9-OTHER").otherwise(F.col("o_orderpriority")).alias("predicted_label"),
        "o_orderstatus",
    )


@query(fx.with_views(PREDICTED, body="select round(avg(case when true_label=predicted_label then 1.0 else 0.0 end),6) as accuracy from preds"))
def accuracy(spark, sf):
    return rounded(metrics.accuracy(class_predictions(spark, sf), "true_label", "predicted_label"))


@query(fx.with_views(PREDICTED, body="select round(avg(r),6) as balanced_accuracy from (select avg(case when true_label=predicted_label then 1.0 else 0.0 end) as r from preds group by true_label)"))
def balanced_accuracy(spark, sf):
    return rounded(metrics.balanced_accuracy(class_predictions(spark, sf), "true_label", "predicted_label"))


GRID = "labels_ as (select true_label as l from preds union select predicted_label from preds)"
MATRIX = "matrix_ as (select a.l as true_label, b.l as predicted_label, (select count(*) from preds p where p.true_label=a.l and p.predicted_label=b.l) as n from labels_ a, labels_ b)"


@query(fx.with_views(PREDICTED, GRID, MATRIX, body="select true_label, predicted_label, n from matrix_"))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(class_predictions(spark, sf), "true_label", "predicted_label").select("true_label", "predicted_label", "n")


@query(fx.with_views(PREDICTED, body="""select a as true_label, b as predicted_label, (select count(*) from preds where true_label=a and predicted_label=b) as n
 from (select unnest(['3-MEDIUM','1-URGENT']) as a), (select unnest(['3-MEDIUM','1-URGENT']) as b)"""))
def confusion_matrix_listed(spark, sf):
    """An explicit label list drops pairs outside it."""
    return metrics.confusion_matrix(class_predictions(spark, sf), "true_label", "predicted_label", ["3-MEDIUM", "1-URGENT"]).select("true_label", "predicted_label", "n")


PRF = """prf as (select l as label, (select count(*) from preds where true_label=l) as support,
 (select count(*) from preds where predicted_label=l) as called, (select count(*) from preds where true_label=l and predicted_label=l) as tp from labels_),
prf2 as (select label, support, case when called>0 then tp/cast(called as double) else 0 end as precision, case when support>0 then tp/cast(support as double) else 0 end as recall,
 case when support+called>0 then 2.0*tp/(support+called) else 0 end as f1 from prf)"""


@query(fx.with_views(PREDICTED, GRID, PRF, body="select label, support, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1 from prf2"))
def per_class_prf(spark, sf):
    return rounded(metrics.per_class_prf(metrics.class_pairs(class_predictions(spark, sf), "true_label", "predicted_label")))


@query(fx.with_views(PREDICTED, GRID, PRF, body="select round(avg(f1),6) as macro_f1, round(sum(f1*support)/sum(support),6) as weighted_f1 from prf2"))
def macro_weighted_f1(spark, sf):
    m = metrics.class_pairs(class_predictions(spark, sf), "true_label", "predicted_label")
    return rounded(metrics.macro_weighted_f1(metrics.per_class_prf(m)))


def _sweep_sql(values: str, extra: str = "") -> str:
    return f"""select threshold_name, round(threshold,6) as threshold, tn, fp, fn, tp, {R.replace("round(specificity,6) as specificity, ", "")} from (
 select *, {RATES} from (select threshold_name, threshold, count(*) filter (where score<threshold and label=0) as tn, count(*) filter (where score>=threshold and label=0) as fp,
 count(*) filter (where score<threshold and label=1) as fn, count(*) filter (where score>=threshold and label=1) as tp
 from labelled, (values {values}) t(threshold_name, threshold) group by all {extra}))"""


def _preset_values(preset: str) -> str:
    return ", ".join(f"('{n}', {t})" for n, t in metrics.PRESETS[preset] if t is not None)


def _preset_sql(preset: str) -> str:
    return fx.with_views(
        fx.LABELLED, SRC, RANKS,
        body=_sweep_sql(_preset_values(preset), "union all select 'youden_j', threshold, tn, fp, fn, tp from best"),
    )


@query(_preset_sql("native"))
def threshold_sweep_native(spark, sf):
    return rounded(metrics.preset_sweep(labelled(spark, sf), "native"))


@query(_preset_sql("foreign"))
def threshold_sweep_foreign(spark, sf):
    return rounded(metrics.preset_sweep(labelled(spark, sf), "foreign"))


@query(
    fx.with_views(
        fx.NORMALS,
        body="""select threshold, count(*) filter (where tumor_probability>=threshold) as tumor_calls, count(*) filter (where tumor_probability<threshold) as normal_calls,
 round(count(*) filter (where tumor_probability>=threshold)/cast(count(*) as double),6) as false_positive_rate
 from normals, (select unnest([0.5,0.75,0.9,0.95,0.99,0.999,0.9999,0.999975,0.99999,0.999999]) as threshold) group by threshold""",
    )
)
def fpr_sweep(spark, sf):
    # Thresholds are fixed values of up to six decimals.
    return rounded(metrics.fpr_sweep(fx.normal_scores(spark, sf), "tumor_probability"))


@query(
    fx.with_views(
        fx.LABELLED, SRC, RANKS, CONFUSION.format(t=0.5),
        body=f"""select tn+fp+fn+tp as n, tp+fn as n_tumor, tn+fp as n_normal, (select round(auc,6) from auc) as auc, (select round(ap,6) from auc) as average_precision,
 round(accuracy,6) as accuracy, round(f1,6) as f1, round(precision,6) as precision, round(recall,6) as recall, tn, fp, fn, tp, 0.5 as threshold from (select *, {RATES} from counts_)""",
    )
)
def summary_labelled(spark, sf):
    return rounded(metrics.labelled_summary(labelled(spark, sf)))


NORMAL_AGG = """count(*) as n, count(*) filter (where tumor_probability>=0.5) as tumor_calls,
 round(count(*) filter (where tumor_probability>=0.5)/cast(count(*) as double),6) as false_positive_rate, round(quantile_cont(tumor_probability,0.5),6) as median_tumor_probability,
 round(max(tumor_probability),6) as max_tumor_probability"""


@query(
    fx.with_views(
        fx.NORMALS,
        body=f"""select {NORMAL_AGG}, 0.5 as threshold, count(*) filter (where tumor_probability<0.5) as normal_calls,
 round(quantile_cont(tumor_probability,0.9),6) as p90_tumor_probability, round(quantile_cont(tumor_probability,0.95),6) as p95_tumor_probability from normals""",
    )
)
def summary_all_normal(spark, sf):
    return rounded(metrics.all_normal_summary(fx.normal_scores(spark, sf)))


@query(fx.with_views(fx.NORMALS, body=f"select primary_site, {NORMAL_AGG} from normals group by primary_site order by false_positive_rate desc, max_tumor_probability desc, primary_site"))
def by_site_summary(spark, sf):
    return rounded(metrics.by_site_summary(fx.normal_scores(spark, sf)))


@query(
    fx.with_views(
        fx.LABELLED,
        body="""select sample_type, count(*) as n, round(avg(score),6) as mean_tumor_probability, round(quantile_cont(score,0.5),6) as median_tumor_probability,
 count(*) filter (where score>=0.5) as tumor_calls from (select *, case when label=1 then 'Primary Tumor' else 'Solid Tissue Normal' end as sample_type from labelled) group by sample_type""",
    )
)
def by_sample_type_summary(spark, sf):
    return rounded(metrics.by_sample_type_summary(typed(spark, sf)))


def typed(spark, sf):
    return labelled(spark, sf).select(
        "sample", "label", F.col("score").alias("tumor_probability"), F.when(F.col("label") == 1, "Primary Tumor").otherwise("Solid Tissue Normal").alias("sample_type")
    )


@query(
    fx.with_views(
        fx.LABELLED,
        body="select sample_type, "
        + ", ".join(f"round(quantile_cont(score,{p}),6) as q{str(p).replace('.', '_')}" for p in metrics.TYPE_QUANTILES)
        + " from (select score, case when label=1 then 'Primary Tumor' else 'Solid Tissue Normal' end as sample_type from labelled) group by sample_type",
    )
)
def score_quantiles_by_group(spark, sf):
    return rounded(metrics.score_quantiles(typed(spark, sf)))


@query(
    """select l_returnflag, """ + ", ".join(f"round(quantile_cont(l_extendedprice,{p}),6) as {n}" for p, n in ((0, "min"), (0.01, "p01"), (0.5, "p50"), (0.99, "p99"), (1, "max"))) + " from lineitem group by l_returnflag"
)
def quantiles(spark, sf):
    from ..operators.qc import named_quantiles

    return rounded(named_quantiles(fx.table(spark, sf, "lineitem"), "l_extendedprice", (0, 0.01, 0.5, 0.99, 1), ["l_returnflag"]))


@query("select count(*) as n, " + ", ".join(f"round(quantile_cont(l_extendedprice,{p}),6) as {n}" for p, n in ((0, "min"), (0.01, "p01"), (0.5, "p50"), (0.99, "p99"), (1, "max"))) + " from lineitem")
def quantiles_whole_column(spark, sf):
    """Bracket and count: no sort of the column."""
    li = fx.table(spark, sf, "lineitem")
    n, q = ranking.exact_cell_quantiles(li, "l_extendedprice", (0, 0.01, 0.5, 0.99, 1))
    names = ("min", "p01", "p50", "p99", "max")
    return rounded(spark.createDataFrame([(n, *map(float, q))], "n bigint, " + ", ".join(f"{c} double" for c in names)))


@query(
    """select count(*) as n_rows, count(distinct event_id) as n_unique_ids, (select count(*) from g) as n_unique_groups, (select count(*) from g where k>1) as n_repeated_groups, (select max(k) from g) as max_rows_per_group
 from (select event_id from events), (select 1) x""".replace("select count(*) as n_rows", "with g as (select user_id, count(*) as k from events where user_id%10<>0 group by user_id) select count(*) as n_rows")
)
def group_audit(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("donor"))
    return cohort.group_audit(e, "event_id", "donor")


@query(fx.with_views(fx.MANIFEST, body="select count(distinct s) as n_unique_biospecimens, count(*) filter (where contains(s,';')) as n_ambiguous_biospecimen_ids from (select case when o_orderkey%9=0 then sample_submitter_id||';x' else sample_submitter_id end as s from manifest)"))
def cohort_biospecimen_audit(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("bio-"), F.expr("o_orderkey div 2").cast("string"), F.when(F.col("o_orderkey") % 9 == 0, ";x").otherwise("")).alias("sample_submitter_id")
    )
    return cohort.biospecimen_audit(o)


PER_PROJECT = fx.with_views(
    fx.LABELLED, "src as (select lang as g, label, score from labelled)", RANKS,
    body="""select g as project, count(*) as n, count(*) filter (where label=1) as n_tumor, count(*) filter (where label=0) as n_normal, round(max(auc),6) as auc,
 round(avg(case when (score>=0.5)=(label=1) then 1.0 else 0.0 end),6) as accuracy from src join auc using (g) group by g order by g""",
)


@query(PER_PROJECT)
def per_project_metrics(spark, sf):
    return rounded(metrics.project_metrics(labelled(spark, sf).withColumnRenamed("lang", "project")))


@query(
    fx.with_views(
        fx.LABELLED, "src as (select lang as g, label, score from labelled union all select '*' as g, label, score from labelled)", RANKS,
        "c as (select count(*) filter (where score>=0.5 and label=1) as tp, count(*) filter (where score>=0.5 and label=0) as fp, count(*) filter (where score<0.5 and label=1) as fn, count(*) filter (where score<0.5 and label=0) as tn from labelled)",
        body="""select 'logistic_regression' as model, (select round(auc,6) from auc where g='*') as pooled_auc, (select round(ap,6) from auc where g='*') as pooled_avg_precision,
 round((tp+tn)/cast(tp+tn+fp+fn as double),6) as pooled_accuracy, round(2.0*tp/(2*tp+fp+fn),6) as pooled_f1,
 (select round(avg(auc),6) from auc where g<>'*') as macro_mean_auc, (select round(min(auc),6) from auc where g<>'*') as macro_min_auc from c""",
    )
)
def pooled_and_macro(spark, sf):
    p = labelled(spark, sf).select("sample", "label", F.col("score").alias("tumor_probability"), F.col("lang").alias("held_out_type"))
    return rounded(metrics.pooled_and_macro(p, metrics.type_metrics(p)))


@query(fx.with_views(fx.LABELLED, "src as (select lang as g, label, score from labelled)", RANKS, body="select count(*) as n_folds, round(avg(auc),6) as mean_auc, round(stddev_pop(auc),6) as std_auc from auc"))
def cv_summary(spark, sf):
    return rounded(metrics.cv_summary(ranking.roc_auc(labelled(spark, sf), groups=["lang"])))


@query(fx.with_views(fx.METADATA, body="select y, count(*) as n_class, round((select count(*) from metadata where not is_test)/(2.0*count(*)),6) as weight from metadata where not is_test group by y"))
def class_weights(spark, sf):
    from ..operators import train

    return rounded(train.class_weights(fx.metadata(spark, sf).where("not is_test")))


@query(fx.with_views(fx.LABELLED, CONFUSION.format(t=0.5), body="select fp, tn, round(case when fp+tn>0 then fp/cast(fp+tn as double) end,6) as fpr from counts_"))
def false_positive_rate(spark, sf):
    return rounded(metrics.false_positive_rate(labelled(spark, sf)))


@query(fx.with_views(fx.NORMALS, body="select sample, primary_site, round(tumor_probability,6) as tumor_probability from normals order by tumor_probability desc, sample limit 20"))
def highest_scoring_normals(spark, sf):
    return rounded(cohort.highest_scoring(fx.normal_scores(spark, sf)).select("sample", "primary_site", "tumor_probability"))


@query(
    fx.with_views(
        fx.LABELLED, "src as (select lang as g, label, score from labelled)", RANKS,
        body="""select a.g as held_out_type, round(a.auc,6) as auc, round((select avg(case when (score>=0.5)=(label=1) then 1.0 else 0.0 end) from src s where s.g=a.g),6) as accuracy_default_thresh,
 round((b.tp+b.tn)/cast(b.tp+b.tn+b.fp+b.fn as double),6) as accuracy_optimal_thresh from auc a join best b using (g)""",
    )
)
def optimal_threshold_per_type(spark, sf):
    p = labelled(spark, sf).select("label", F.col("score").alias("tumor_probability"), F.col("lang").alias("held_out_type"))
    return rounded(metrics.optimal_threshold_per_type(p))



@query(
    fx.with_views(
        fx.LABELLED,
        "src as (select lang as g, label, score from labelled union all select lang||'#w', label, score from labelled where score<0.9)",
        RANKS,
        "m as (select g, count(*) as n, avg(case when (score>=0.5)=(label=1) then 1.0 else 0.0 end) as acc, count(*) filter (where score>=0.5 and label=1)/cast(count(*) filter (where label=1) as double) as rec from src group by g)",
        body="""select h.g as held_out_type, hm.n as n_test, round(h.auc,6) as loco_auc, round(hm.acc,6) as loco_acc, round(hm.rec,6) as loco_recall, wm.n as within_n, round(w.auc,6) as within_auc,
 round(wm.acc,6) as within_acc, round(w.auc-h.auc,6) as auc_drop from auc h join m hm using (g) join auc w on w.g=h.g||'#w' join m wm on wm.g=w.g order by auc_drop desc""",
    )
)
def within_vs_heldout(spark, sf):
    l = labelled(spark, sf)  # noqa: E741
    loco = metrics.type_metrics(l.select("label", F.col("score").alias("tumor_probability"), F.col("lang").alias("held_out_type")))
    within = metrics.project_metrics(l.where("score < 0.9").withColumnRenamed("lang", "project"))
    return rounded(metrics.within_vs_heldout(loco, within))


@query(
    fx.with_views(
        fx.LABELLED, "src as (select lang as g, label, score from labelled union all select lang||'#w', label, score from labelled where score<0.9)", RANKS,
        "m as (select a.g, max(auc) as auc, avg(case when (score>=0.5)=(label=1) then 1.0 else 0.0 end) as acc, count(*) as n from src a join auc using (g) group by a.g)",
        body="""select metric, 0 as unmatched, (select count(*) from m a join m b on b.g=a.g||'#w' where a.n<>b.n) as changed,
 case metric when 'auc' then (select round(max(abs(a.auc-b.auc)),6) from m a join m b on b.g=a.g||'#w') else (select round(max(abs(a.acc-b.acc)),6) from m a join m b on b.g=a.g||'#w') end as max_abs_delta,
 false as within_tolerance from (select unnest(['auc','accuracy']) as metric)""",
    )
)
def compare_metric_tables(spark, sf):
    l = labelled(spark, sf).withColumnRenamed("lang", "project")  # noqa: E741
    a, b = metrics.project_metrics(l), metrics.project_metrics(l.where("score < 0.9"))
    return rounded(metrics.compare_metric_tables(a, b, "project", ["n"], ["auc", "accuracy"]))


# --- calibration -----------------------------------------------------------


CALIBRATION = fx.with_views(
    fx.LABELLED, SRC, RANKS,
    body=f"""select threshold_name, round(threshold,6) as threshold, tn, fp, fn, tp, {R}, round(youden_j,6) as youden_j from (select *, {RATES} from (
 select threshold_name, threshold, count(*) filter (where score<threshold and label=0) as tn, count(*) filter (where score>=threshold and label=0) as fp,
 count(*) filter (where score<threshold and label=1) as fn, count(*) filter (where score>=threshold and label=1) as tp, null as youden_j
 from labelled, (values ('default',0.5),('threshold_0.25',0.25)) t(threshold_name, threshold) group by all
 union all select 'youden_j', threshold, tn, fp, fn, tp, youden_j from best))""",
)


@query(CALIBRATION)
def calibration_table(spark, sf):
    return rounded(calibrate.threshold_table(labelled(spark, sf), 0.5, [0.25], "label", "score"))


@query(
    fx.with_views(
        fx.LABELLED, SRC, RANKS,
        body="""select tp+fn+tn+fp as n, tp+fn as n_tumor, tn+fp as n_normal, (select round(auc,6) from auc) as auc, round(threshold,6) as recommended_threshold, 'youden_j' as recommended_metric,
 round((tp+tn)/cast(tp+tn+fp+fn as double),6) as recommended_accuracy, round(tp/cast(tp+fn as double),6) as recommended_recall, round(tn/cast(tn+fp as double),6) as recommended_specificity,
 'apparent_resubstitution' as evaluation_type, case when least(tp+fn,tn+fp)<10 then 1 else 0 end as n_warnings from best""",
    )
)
def calibration_summary(spark, sf):
    s = calibrate.calibration_summary(labelled(spark, sf), "label", "score")
    return rounded(s.withColumn("n_warnings", F.size("warnings")).drop("warnings"))


@query(CALIBRATION)
def calibrate_scores(spark, sf):
    """The whole operator: checked join of scores and labels, then the table."""
    table, _ = calibrate.calibrate(fx.scores(spark, sf), fx.labels(spark, sf), [0.25], min_match_fraction=0.1)
    return rounded(table)
