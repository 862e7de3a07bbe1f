"""Alignment, scoring, explanation, QC, cohort modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import adapt, align as align_ops, cohort, explain as explain_ops, model as model_ops, qc, score as score_ops
from . import fixtures as fx
from .check_queries import DEGRADED_TOTALS, GENE_META, gene_meta
from .common import rounded
from .metric_queries import RANKS
from .registry import query

BINARY = (fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL)
SCORED = (*BINARY, fx.LOGITS)
MULTI = (fx.EXPRESSION, fx.METADATA, fx.MULTICLASS_MODEL)
# Degraded cells on model genes, missing and invalid ones imputed.
ALIGNED = """aligned as (
  select s.sample, m.pos, m.gene_id, m.mean, m.scale, m.coef, d.value as raw, d.sample is not null as matched, coalesce(d.value, m.mean) as x
  from (select distinct sample from expression) s cross join model m left join degraded d on d.sample=s.sample and d.pos=m.pos)"""
DEGRADED_SCORED = """z as (select *, (x-mean)/scale as z from aligned),
logits as (select sample, sum(z*coef) as logit from z group by sample),
scored as (select sample, logit, case when logit>=0 then 1/(1+exp(-logit)) else exp(logit)/(1+exp(logit)) end as p from logits)"""
DEGRADED_VIEWS = (*BINARY, fx.DEGRADED, ALIGNED, DEGRADED_SCORED)


# --- alignment -------------------------------------------------------------


@query(
    fx.with_views(
        fx.EXPRESSION, fx.DEGRADED,
        "h as (select distinct pos as hpos, gene_id from degraded)",
        "wanted as (select distinct pos, gene_id from expression)",
        body="""select w.pos, w.gene_id, row_number() over (partition by h.hpos is null order by h.hpos)-1 as source_pos, h.gene_id as source_gene
 from wanted w join h on h.hpos=w.pos union all select pos, gene_id, null, null from wanted where pos not in (select hpos from h)""",
    )
)
def align_genes(spark, sf):
    header = fx.degraded(spark, sf).header()
    return align_ops.match_genes(header, fx.gene_table(spark))


@query(
    fx.with_views(
        GENE_META,
        "ids_ as (select gene_id from meta union all select gene_id_base from meta where hash(gene_id_base)=0)",
        body="""select gene_base, n_columns, n_ids, columns, case when n_ids<n_columns then 'duplicate' else 'version_collision' end as kind from (
 select regexp_replace(gene_id,'\\.[0-9]+$','') as gene_base, count(*) as n_columns, count(distinct gene_id) as n_ids, string_agg(distinct gene_id, ', ' order by gene_id) as columns from meta group by 1 having count(*)>1)""",
    )
)
def gene_collisions(spark, sf):
    return align_ops.gene_collisions(gene_meta(spark, sf))


REPORT_SQL = fx.with_views(
    fx.EXPRESSION, fx.DEGRADED, DEGRADED_TOTALS,
    body="""select n_samples, 64 as n_model_genes, k as n_matched_genes, 64-k as n_missing_genes, n_samples*k as matched_cells, invalid as invalid_matched_cells,
 round(invalid/cast(n_samples*k as double),6) as invalid_matched_fraction, (select count(*) from per_gene where bad>0) as n_genes_with_invalid_values, all_bad_genes as n_genes_with_all_invalid_values,
 bad_samples as n_samples_with_invalid_values, all_bad_samples as n_samples_with_all_invalid_values, round(worst/cast(k as double),6) as max_invalid_fraction,
 (select string_agg(g, ',' order by pos) from (select distinct pos, gene_id as g from expression where pos not in (select pos from degraded))) as missing_genes,
 (select string_agg(t, ',' order by pos) from (select pos, (select any_value(gene_id) from expression e where e.pos=p.pos)||'<'||gene_id||':'||cast(bad as varchar) as t from per_gene p where bad>0 order by pos limit 20)) as first_genes,
 (select string_agg(sample||':'||cast(bad as varchar), ',' order by sample) from (select * from per_sample where bad>0 order by sample limit 20)) as first_samples from totals""",
)


@query(REPORT_SQL)
def alignment_report(spark, sf):
    a = align_ops.align(fx.degraded(spark, sf), fx.binary_model(spark, sf))
    r = align_ops.alignment_report(a)
    return rounded(
        r.select(
            "n_samples", "n_model_genes", "n_matched_genes", "n_missing_genes", "matched_cells", "invalid_matched_cells", "invalid_matched_fraction",
            "n_genes_with_invalid_values", "n_genes_with_all_invalid_values", "n_samples_with_invalid_values", "n_samples_with_all_invalid_values",
            F.col("max_invalid_matched_cell_fraction_per_sample").alias("max_invalid_fraction"),
            F.array_join("missing_genes", ",").alias("missing_genes"),
            F.array_join(F.transform("first_genes_with_invalid_values", lambda x: F.concat(x["gene"], F.lit("<"), x["source_column"], F.lit(":"), x["invalid_cells"].cast("string"))), ",").alias("first_genes"),
            F.array_join(F.transform("first_samples_with_invalid_values", lambda x: F.concat(x["sample"], F.lit(":"), x["invalid_cells"].cast("string"))), ",").alias("first_samples"),
        )
    )


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA,
        "cells as (select gene_id, project, case when pos%5=2 or (pos%5=3 and project<>'TCGA-T0') then null else value end as value from expression join metadata using (sample))",
        body="select gene_id, count(*) as n_cells, count(value) as n_finite from cells where gene_id not in (select gene_id from cells group by gene_id having count(value)=0) group by gene_id",
    )
)
def drop_all_missing_genes(spark, sf):
    m = fx.labelled_expression(spark, sf)
    cells = m.rows.select("project", F.posexplode("cells").alias("pos", "v")).join(F.broadcast(fx.gene_table(spark)), "pos")
    gone = (F.col("pos") % 5 == 2) | ((F.col("pos") % 5 == 3) & (F.col("project") != "TCGA-T0"))
    cells = cells.select("gene_id", F.when(~gone, F.col("v")).alias("value"))
    return align_ops.drop_all_missing_genes(cells).groupBy("gene_id").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_finite"))


# --- models ----------------------------------------------------------------


@query(
    fx.with_views(
        *BINARY,
        body="""select part, 0 as n_identity_changes, case part when 'coef' then (select round(max(abs(coef*0.01)),6) from model) when 'intercept' then 0.25 else 0 end as max_abs_delta,
 part in ('mean','scale') as within_tolerance from (select unnest(['mean','scale','coef','intercept']) as part)""",
    )
)
def compare_models(spark, sf):
    """The model against itself with 1 % larger coefficients and a moved cut."""
    t = fx.binary_tables(spark, sf)
    moved = model_ops.ModelTables(
        t.genes, t.coef.withColumn("coef", F.col("coef") * 1.01), t.head.withColumn("intercept", F.col("intercept") + 0.25), "binary"
    )
    return rounded(model_ops.compare_models(t, moved))


@query(fx.with_views(*BINARY, body="select sample, 1 as class_idx, round(sum((value-mean)/scale*coef),6) as dot from expression join model using (pos) group by sample"))
def model_dot_binary(spark, sf):
    t = fx.binary_tables(spark, sf)
    return rounded(score_ops.model_dot(fx.expression(spark, sf).long(), t.genes, t.coef))


@query(fx.with_views(*MULTI, body="select sample, class_idx, round(sum((value-mean)/scale*coef),6) as dot from expression join class_coef using (pos) group by sample, class_idx"))
def model_dot_multiclass(spark, sf):
    t = fx.multiclass_tables(spark, sf)
    return rounded(score_ops.model_dot(fx.expression(spark, sf).long(), t.genes, t.coef))


# --- scalar functions ------------------------------------------------------


@query(
    """select raw, round(number,6) as number, count(*) as n from (select raw, case when regexp_full_match(raw,'\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') then cast(trim(raw) as double) end as number from (
 select case o_orderkey%9 when 0 then cast(o_custkey%50 as varchar) when 1 then ' '||cast(o_custkey%7 as varchar)||'.5 ' when 2 then '1e3' when 3 then 'NA' when 4 then 'inf' when 5 then '1.5d' when 6 then '' when 7 then 'NaN' else '-.25' end as raw from orders)) group by all"""
)
def to_number(spark, sf):
    k, c = F.col("o_orderkey") % 9, F.col("o_custkey")
    raw = (
        F.when(k == 0, (c % 50).cast("string")).when(k == 1, F.concat(F.lit(" "), (c % 7).cast("string"), F.lit(".5 "))).when(k == 2, "1e3").when(k == 3, "NA")
        .when(k == 4, "inf").when(k == 5, "1.5d").when(k == 6, "").when(k == 7, "NaN").otherwise("-.25")
    )
    return rounded(
        fx.table(spark, sf, "orders").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).select("raw", numeric.to_number("raw").alias("number"), "n")
    )


@query("select event_id, round(case when x>=0 then 1/(1+exp(-x)) else exp(x)/(1+exp(x)) end,6) as p from (select event_id, (value-20)*case when event_id%100=0 then 1000 else 0.1 end as x from events)")
def sigmoid(spark, sf):
    x = (F.col("value") - 20) * F.when(F.col("event_id") % 100 == 0, 1000.0).otherwise(0.1)
    return rounded(fx.table(spark, sf, "events").select("event_id", numeric.sigmoid(x).alias("p")))


@query(
    fx.with_views(
        "x as (select vec_id, unnest(range(0,len(embedding))) as i, embedding from embeddings)",
        "e as (select vec_id, i, exp(cast(embedding[i+1] as double)-cast(list_max(embedding) as double)) as e from x)",
        body="select vec_id, i as class_idx, round(e/sum(e) over (partition by vec_id),6) as p from e",
    )
)
def softmax(spark, sf):
    s = fx.table(spark, sf, "embeddings").select("vec_id", numeric.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("p"))
    return rounded(s.select("vec_id", F.posexplode("p").alias("class_idx", "p")))


MODES_SQL = """cohort as (select pos, avg(x) as m, case when stddev_pop(x)=0 then 1 else stddev_pop(x) end as s from aligned group by pos)"""


@query(
    fx.with_views(
        *BINARY, fx.DEGRADED, ALIGNED, MODES_SQL,
        body="""select sample, round(sum(abs((x-mean)/scale)),6) as none, round(sum(abs((x-m)/s)),6) as cohort_zscore, round(sum(abs((x-m)/scale)),6) as cohort_center from aligned join cohort using (pos) group by sample""",
    )
)
def standardize_modes(spark, sf):
    """Sum of |z| per sample under each mode; a missing gene has z = 0."""
    a = align_ops.align(fx.degraded(spark, sf), fx.binary_model(spark, sf))
    stats = adapt.cohort_stats(a)
    size = lambda z: numeric.array_sum(F.transform(z, lambda v: F.abs(v)))
    return rounded(
        a.rows.select(
            "sample",
            size(score_ops.standardize(F.col("x"), a.model)).alias("none"),
            *[size(score_ops.standardize(a.imputed(), a.model, m, stats)).alias(m) for m in ("cohort_zscore", "cohort_center")],
        )
    )


@query("select l_orderkey, l_linenumber, round(case when v>=0 then log2(v+1) end,6) as value from (select l_orderkey, l_linenumber, case when l_linenumber=3 then -l_quantity else l_quantity end as v from lineitem)")
def log2_tpm1(spark, sf):
    v = F.when(F.col("l_linenumber") == 3, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return rounded(fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numeric.log2_tpm1(v).alias("value")))


@query("select event_id, round(case when pow(2,v)-0.001>=-1e-6 then log2(greatest(pow(2,v)-0.001,0)+1) end,6) as value from (select event_id, value/10.0-case when event_id%50=0 then 12.0 else 5.0 end as v from events)")
def xena_to_model_scale(spark, sf):
    v = F.col("value") / 10.0 - F.when(F.col("event_id") % 50 == 0, 12.0).otherwise(5.0)
    return rounded(fx.table(spark, sf, "events").select("event_id", numeric.decode_log2_tpm001(v).alias("value")))


@query(
    fx.with_views(
        fx.NORMALS,
        body="""select sample, round(tumor_probability,1) as shown, case when tumor_probability>=0.45 then 'tumor' else 'normal' end as exact_call,
 case when round(tumor_probability,1)>=0.45 then 'tumor' else 'normal' end as shown_call from normals""",
    )
)
def call_by_threshold(spark, sf):
    """The call follows the full value, or the rounded one when rounding is asked."""
    p = fx.normal_scores(spark, sf).select("sample", F.col("tumor_probability").alias("probability"))
    exact = score_ops.binary_scores(p, 0.45).select("sample", F.col("call").alias("exact_call"))
    shown = score_ops.binary_scores(p, 0.45, round_digits=1).select("sample", F.col("tumor_probability").alias("shown"), F.col("call").alias("shown_call"))
    return exact.join(shown, "sample")


@query("select vec_id, 'c'||cast(list_position(v, list_max(v))-1 as varchar) as cls from (select vec_id, [round(cast(x as double),1) for x in embedding] as v from embeddings)")
def argmax_class(spark, sf):
    """Coarse values, so that ties are common and the first class must win."""
    p = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 1)).alias("p"))
    return p.select("vec_id", numeric.argmax_class("p", [f"c{i}" for i in range(64)]).alias("cls"))


@query(fx.with_views(*BINARY, body="select gene_id, case when coef>=0 then 'tumor' else 'normal' end as direction from model"))
def direction_if_high(spark, sf):
    t = fx.binary_tables(spark, sf)
    return t.genes.join(t.coef, "pos").select("gene_id", numeric.direction_if_high("coef").alias("direction"))


@query("select l_returnflag, count(*) as n, round(sum(v),6) as total, count(v) as n_finite from (select l_returnflag, case when l_linenumber<>1 then l_discount end as v from lineitem) group by l_returnflag")
def finite_or_null(spark, sf):
    v = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_discount"))
    clean = fx.table(spark, sf, "lineitem").select("l_returnflag", numeric.finite_or_null(v).alias("v"))
    return rounded(clean.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count("v").alias("n_finite")))


@query("select n_regionkey, array_to_string((list(n_name order by n_nationkey))[1:3], ', ')||case when count(*)>3 then ', ...' else '' end as preview from nation group by n_regionkey")
def preview(spark, sf):
    names = fx.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("v"))
    return names.select("n_regionkey", numeric.preview("v", 3).alias("preview"))


# --- scoring ---------------------------------------------------------------


@query(fx.with_views(*SCORED, body="select sample, round(logit,6) as logit from scored"))
def contribution_logit(spark, sf):
    a = align_ops.align(fx.expression(spark, sf), fx.binary_model(spark, sf))
    return rounded(explain_ops.contributions(a).select("sample", "logit"))


@query(fx.with_views(*SCORED, body="select sample, round(p,6) as probability from scored"))
def predict_proba(spark, sf):
    return rounded(score_ops.predict_proba(fx.binary_model(spark, sf), fx.expression(spark, sf)))


@query(fx.with_views(*DEGRADED_VIEWS, body="select sample, round(p,6) as probability from scored"))
def predict_proba_degraded(spark, sf):
    """Missing genes filled, invalid cells allowed after review."""
    return rounded(score_ops.predict_proba(fx.binary_model(spark, sf), fx.degraded(spark, sf), allow_invalid=True))


@query(fx.with_views(*SCORED, body="select sample, round(p,6) as tumor_probability, case when p>=0.5 then 'tumor' else 'normal' end as call from scored"))
def score_binary(spark, sf):
    return rounded(score_ops.score_binary(fx.binary_model(spark, sf), fx.expression(spark, sf)))


PROBS = """dots as (select sample, class, class_idx, sum((value-mean)/scale*coef) as d from expression join class_coef using (pos) group by all),
e as (select *, exp(d-max(d) over (partition by sample)) as e from dots),
probs as (select sample, class, class_idx, e/sum(e) over (partition by sample) as p from e)"""


@query(fx.with_views(*MULTI, PROBS, body="select sample, class, round(p,6) as p from probs"))
def predict_proba_multiclass(spark, sf):
    m = fx.multiclass_model(spark, sf)
    scored = score_ops.predict_proba(m, fx.expression(spark, sf))
    return rounded(scored.select("sample", F.posexplode("probability").alias("i", "p")).select("sample", F.get(numeric.string_array(m.classes), F.col("i")).alias("class"), "p"))


@query(fx.with_views(*MULTI, PROBS, body="select sample, class as predicted from (select *, row_number() over (partition by sample order by p desc, class_idx) as rn from probs) where rn=1"))
def predict_multiclass(spark, sf):
    return score_ops.predict(fx.multiclass_model(spark, sf), fx.expression(spark, sf))


@query(fx.with_views(*SCORED, body="select sample, case when p>=0.6 then 'tumor' else 'normal' end as predicted from scored"))
def predict_binary(spark, sf):
    return score_ops.predict(fx.binary_model(spark, sf), fx.expression(spark, sf), 0.6)


TOPK = """r as (select *, row_number() over (partition by sample order by p desc, class_idx) as rn from probs),
pred as (select sample, max(case when rn=1 then class end) as predicted_type, round(max(case when rn=1 then p end),4) as probability,
 max(case when rn=1 then class||':'||printf('%.3f',p) end) as top1, max(case when rn=2 then class||':'||printf('%.3f',p) end) as top2, max(case when rn=3 then class||':'||printf('%.3f',p) end) as top3 from r group by sample)"""


@query(fx.with_views(*MULTI, PROBS, TOPK, body="select * from pred"))
def predict_cancer_type(spark, sf):
    return score_ops.predict_cancer_type(fx.multiclass_model(spark, sf), fx.expression(spark, sf), 3)


@query(fx.with_views(*MULTI, PROBS, TOPK, body="select predicted_type, count(*) as n from pred group by predicted_type"))
def call_distribution(spark, sf):
    return score_ops.call_distribution(score_ops.predict_cancer_type(fx.multiclass_model(spark, sf), fx.expression(spark, sf), 1))


# --- explanation -----------------------------------------------------------


def _explain_sql(views, value, source) -> str:
    return fx.with_views(
        *views,
        f"t as (select s.sample, p, logit, gene_id, {value} as x, mean, ({value}-mean)/scale as zz, coef, ({value}-mean)/scale*coef as term from {source} s join scored using (sample))",
        "r as (select *, case when term>0 then 'tumor' else 'normal' end as direction, row_number() over (partition by sample, term>0 order by abs(term) desc, gene_id) as rank from t where term<>0)",
        body="""select sample, round(p,6) as tumor_probability, round(logit,6) as logit, direction, rank, gene_id, 'N'||substr(gene_id,5,11) as gene_name, round(term,6) as contribution_logit,
 round(x,6) as expression_log2_tpm1, round(mean,6) as training_mean, round(zz,6) as scaled_value, round(coef,6) as lr_coef from r where rank<=3""",
    )


def named_genes(spark):
    """Names under version-free ids only, to take the fallback."""
    g = fx.gene_table(spark)
    base = F.substring_index("gene_id", ".", 1)
    return g.select(F.concat(base, F.lit(".99")).alias("gene_id"), base.alias("gene_id_base"), F.concat(F.lit("N"), F.substring("gene_id", 5, 11)).alias("gene_name"))


@query(_explain_sql(SCORED, "value", "(select * from expression join (select pos, mean, scale, coef from model) using (pos))"))
def explain_scores(spark, sf):
    return rounded(explain_ops.explain(fx.binary_model(spark, sf), fx.expression(spark, sf), 3, named_genes(spark)))


@query(
    fx.with_views(
        *BINARY,
        "t as (select sample, gene_id, (value-mean)/scale*coef as term from (select sample, pos, value from expression) join model using (pos))",
        "r as (select *, row_number() over (partition by sample, term>0 order by abs(term) desc, gene_id) as rank from t where term<>0)",
        body="select sample, case when term>0 then 'tumor' else 'normal' end as direction, rank, gene_id, round(term,6) as term from r where rank<=2",
    )
)
def top_contributions_long(spark, sf):
    t = fx.binary_tables(spark, sf)
    terms = (
        fx.expression(spark, sf).long().join(F.broadcast(t.genes.join(t.coef, "pos").select("pos", "mean", "scale", "coef")), "pos")
        .select("sample", "gene_id", ((F.col("value") - F.col("mean")) / F.col("scale") * F.col("coef")).alias("term"))
    )
    return rounded(explain_ops.top_contributions_long(terms, 2).select("sample", "direction", "rank", "gene_id", "term"))


@query(fx.with_views(*BINARY, body="select gene_id, round(coef,6) as coef, row_number() over (order by abs(coef) desc, pos) as rank_abs_lr_coef from model"))
def rank_genes_by_abs_coef(spark, sf):
    t = fx.binary_tables(spark, sf)
    return rounded(explain_ops.rank_genes_by_abs_coef(t.genes, t.coef).select("gene_id", "coef", "rank_abs_lr_coef"))


NAMES = """src1 as (select 'ENSG'||lpad(cast(p_partkey%40 as varchar),11,'0') as gene_id, 'P'||cast(max(p_partkey) as varchar) as gene_name from part group by p_partkey%40),
src2 as (select 'ENSG'||lpad(cast(s_suppkey%20 as varchar),11,'0')||'.'||cast((s_suppkey%20)%9+1 as varchar) as gene_id, 'S'||cast(max(s_suppkey) as varchar) as gene_name from supplier group by s_suppkey%20),
named as (select gene_id as key, gene_name, 0 as src from src1 union all select gene_id, gene_name, 1 from src2 union all select regexp_replace(gene_id,'\\.[0-9]+$',''), gene_name, 1 from src2),
names as (select key, arg_max(gene_name, src) as gene_name from named group by key)"""


def name_sources(spark, sf):
    gene = lambda c: F.concat(F.lit("ENSG"), F.lpad(c.cast("string"), 11, "0"))
    p = fx.table(spark, sf, "part").groupBy((F.col("p_partkey") % 40).alias("g")).agg(F.max("p_partkey").alias("m"))
    s = fx.table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 20).alias("g")).agg(F.max("s_suppkey").alias("m"))
    return [
        p.select(gene(F.col("g")).alias("gene_id"), F.concat(F.lit("P"), F.col("m").cast("string")).alias("gene_name")),
        s.select(F.concat(gene(F.col("g")), F.lit("."), (F.col("g") % 9 + 1).cast("string")).alias("gene_id"), F.concat(F.lit("S"), F.col("m").cast("string")).alias("gene_name")),
    ]


@query(
    fx.with_views(
        *BINARY, NAMES,
        body="""select gene_id, coalesce(a.gene_name, b.gene_name, '') as gene_name from model m left join names a on a.key=m.gene_id left join names b on b.key=regexp_replace(m.gene_id,'\\.[0-9]+$','')""",
    )
)
def attach_gene_names(spark, sf):
    names = explain_ops.known_gene_names(name_sources(spark, sf))
    return explain_ops.attach_gene_names(fx.gene_table(spark), names).select("gene_id", "gene_name")


@query(
    fx.with_views(
        *BINARY, NAMES,
        body="""select row_number() over (order by abs(coef) desc, pos) as rank_abs_lr_coef, gene_id, regexp_replace(gene_id,'\\.[0-9]+$','') as gene_id_base, coalesce(a.gene_name, b.gene_name, '') as gene_name,
 round(coef,6) as lr_coef, round(abs(coef),6) as abs_lr_coef, case when coef>=0 then 'tumor' else 'normal' end as direction_if_high, round(mean,6) as scaler_mean, round(scale,6) as scaler_scale
 from model m left join names a on a.key=m.gene_id left join names b on b.key=regexp_replace(m.gene_id,'\\.[0-9]+$','')""",
    )
)
def gene_metadata(spark, sf):
    t = fx.binary_tables(spark, sf)
    return rounded(explain_ops.gene_metadata(t.genes, t.coef, explain_ops.known_gene_names(name_sources(spark, sf))))


@query(
    fx.with_views(
        *MULTI,
        "r as (select class, pos, coef, row_number() over (partition by class order by coef desc, pos) as rank from class_coef)",
        body="select class as cancer_type, rank, 'ENSG'||lpad(cast(pos as varchar),11,'0')||'.'||cast(pos%9+1 as varchar) as gene, case when pos%2=0 then 'SYM'||cast(pos as varchar) else '' end as symbol, round(coef,6) as coef from r where rank<=15",
    )
)
def top_genes_per_class(spark, sf):
    t = fx.multiclass_tables(spark, sf)
    symbols = fx.gene_table(spark).where("pos % 2 = 0").select("gene_id", F.concat(F.lit("SYM"), F.col("pos").cast("string")).alias("symbol"))
    return rounded(explain_ops.top_genes_per_class(t.genes, t.coef, t.head, symbols, 15))


# --- QC --------------------------------------------------------------------

QC_SAMPLE = """per_sample as (select sample, quantile_cont(abs(z),0.5) as med, quantile_cont(abs(z),0.95) as p95, count(*) filter (where abs(z)>6) as g6, count(*) filter (where abs(z)>10) as g10,
  count(raw) as n_finite, count(*) filter (where raw < -1e-9) as n_neg from z group by sample),
per_gene as (select pos, abs(avg(z)) as gm from z group by pos)"""


def aligned(spark, sf, shift=0.0):
    return align_ops.align(fx.degraded(spark, sf, shift), fx.binary_model(spark, sf))


@query(fx.with_views(*DEGRADED_VIEWS, QC_SAMPLE, body="select sample, round(med,6) as median_abs_z, round(p95,6) as p95_abs_z, n_finite, g6 as n_gt_6, round(p,6) as tumor_probability from per_sample join scored using (sample)"))
def sample_shift_stats(spark, sf):
    return rounded(qc.sample_stats(aligned(spark, sf)).select("sample", "median_abs_z", "p95_abs_z", "n_finite", "n_gt_6", "tumor_probability"))


SHIFT_NAMES = ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (1, "max"))
SHIFT_SQL = ", ".join(f"round(quantile_cont({{c}},{p}),6) as {n}" for p, n in SHIFT_NAMES)


@query(
    fx.with_views(
        *DEGRADED_VIEWS, QC_SAMPLE,
        body="select 'sample_median_abs_z' as figure, " + SHIFT_SQL.format(c="med") + " from per_sample union all select 'sample_p95_abs_z', " + SHIFT_SQL.format(c="p95")
        + " from per_sample union all select 'tumor_probability', " + SHIFT_SQL.format(c="p") + " from scored",
    )
)
def sample_shift_quantiles(spark, sf):
    q = qc.sample_shift(qc.sample_stats(aligned(spark, sf)))
    probs = sorted(set(qc.SHIFT_PROBS + qc.SCORE_PROBS))
    return rounded(q.select("figure", *[F.get("q", F.lit(probs.index(p))).alias(n) for p, n in SHIFT_NAMES]))


@query(fx.with_views(*DEGRADED_VIEWS, QC_SAMPLE, body="select " + SHIFT_SQL.format(c="gm") + " from per_gene"))
def gene_shift_stats(spark, sf):
    return rounded(qc.gene_shift_quantiles(aligned(spark, sf)))


@query(
    fx.with_views(
        *BINARY, fx.DEGRADED.replace("else value end", "else value+10 end"), ALIGNED, DEGRADED_SCORED,
        body="select round(avg(case when abs(z)>6 then 1.0 else 0.0 end),6) as abs_z_gt_6_fraction, round(avg(case when abs(z)>10 then 1.0 else 0.0 end),6) as abs_z_gt_10_fraction from z",
    )
)
def extreme_fraction(spark, sf):
    """Every value moved up by ten."""
    t = qc.cell_totals(qc.sample_stats(aligned(spark, sf, 10.0)), fx.N_GENES)
    return rounded(t.select("abs_z_gt_6_fraction", "abs_z_gt_10_fraction"))


@query(
    fx.with_views(
        *DEGRADED_VIEWS,
        body="""select count(raw) as finite_values, round(1-count(raw)/cast(count(*) as double),6) as nonfinite_fraction, round(count(*) filter (where raw < -1e-9)/cast(count(raw) as double),6) as negative_fraction,
 round(min(raw),6) as min, round(quantile_cont(raw,0.01),6) as p01, round(quantile_cont(raw,0.5),6) as p50, round(quantile_cont(raw,0.99),6) as p99, round(max(raw),6) as max from z""",
    )
)
def value_summary(spark, sf):
    return rounded(qc.value_summary(aligned(spark, sf)))


@query(
    fx.with_views(
        *DEGRADED_VIEWS,
        body="""select count(*) filter (where p>=0.5) as tumor_calls, count(*) filter (where p<0.5) as normal_calls, round(avg(case when p>=0.5 then 1.0 else 0.0 end),6) as tumor_call_fraction,
 round(avg(case when p>=0.99 then 1.0 else 0.0 end),6) as probability_ge_0_99_fraction, round(avg(case when p<=0.01 then 1.0 else 0.0 end),6) as probability_le_0_01_fraction from scored""",
    )
)
def score_summary(spark, sf):
    t = qc.cell_totals(qc.sample_stats(aligned(spark, sf)), fx.N_GENES)
    return rounded(t.select("tumor_calls", "normal_calls", "tumor_call_fraction", "probability_ge_0_99_fraction", "probability_le_0_01_fraction"))


def _inspect_sql(shift: str, match: str, codes: str, status: str) -> str:
    views = list(DEGRADED_VIEWS)
    views[3] = fx.DEGRADED.replace("else value end", f"else value+{shift} end")
    return f"""select 'input' as cohort, '{status}' as status, count(distinct sample) as samples, {match} as matched_model_genes, round({match}/64.0,6) as match_rate, count(raw) as finite_model_gene_values,
 round(1-count(raw)/cast(count(*) as double),6) as nonfinite_or_missing_fraction, round(count(*) filter (where raw < -1e-9)/cast(count(raw) as double),6) as negative_fraction,
 round(quantile_cont(raw,0.5),6) as value_p50, round(quantile_cont(raw,0.99),6) as value_p99, round(max(raw),6) as value_max,
 (select round(quantile_cont(med,0.5),6) from per_sample) as sample_median_abs_z_p50, (select round(quantile_cont(p95,0.5),6) from per_sample) as sample_p95_abs_z_p50,
 (select round(quantile_cont(gm,0.99),6) from per_gene) as gene_mean_abs_z_p99, (select round(max(gm),6) from per_gene) as gene_mean_abs_z_max,
 round(avg(case when abs(z)>6 then 1.0 else 0.0 end),6) as abs_z_gt_6_fraction, round(avg(case when abs(z)>10 then 1.0 else 0.0 end),6) as abs_z_gt_10_fraction,
 (select count(*) from scored where p>=0.5) as tumor_calls, (select count(*) from scored where p<0.5) as normal_calls, (select round(quantile_cont(p,0.5),6) from scored) as tumor_probability_p50,
 '{codes}' as message_codes from z""", views


def _inspect(shift: str, codes: str, status: str) -> str:
    body, views = _inspect_sql(shift, "55", codes, status)
    return fx.with_views(*views, QC_SAMPLE, body=body)


@query(_inspect("0", "low_model_gene_match,nonfinite_or_missing_values", "WARN"))
def inspect(spark, sf):
    r = qc.inspect(fx.binary_model(spark, sf), fx.degraded(spark, sf))
    return rounded(qc.report_frame(spark, {"input": r})).drop("report_json")


@query(_inspect("10", "low_model_gene_match,nonfinite_or_missing_values,expression_values_high,many_extreme_standardized_values,very_extreme_standardized_values,cohort_distribution_shift,large_cohort_gene_shift", "WARN"))
def inspect_shifted(spark, sf):
    """All values ten too high: range and shift rules fire."""
    r = qc.inspect(fx.binary_model(spark, sf), fx.degraded(spark, sf, 10.0))
    return rounded(qc.report_frame(spark, {"input": r})).drop("report_json")


def _cohort_report(cohort: str, z: str, matched: int, status: str, codes: str) -> str:
    """Report row of one cohort from its z view (sample, pos, raw, z)."""
    return f"""select '{cohort}' as cohort, '{status}' as status, count(distinct sample) as samples, {matched} as matched_model_genes, round({matched}/64.0,6) as match_rate, count(raw) as finite_model_gene_values,
 round(1-count(raw)/cast(count(*) as double),6) as nonfinite_or_missing_fraction, round(count(*) filter (where raw < -1e-9)/cast(count(raw) as double),6) as negative_fraction,
 round(quantile_cont(raw,0.5),6) as value_p50, round(quantile_cont(raw,0.99),6) as value_p99, round(max(raw),6) as value_max,
 (select round(quantile_cont(m,0.5),6) from (select quantile_cont(abs(z),0.5) as m from {z} group by sample)) as sample_median_abs_z_p50,
 (select round(quantile_cont(m,0.5),6) from (select quantile_cont(abs(z),0.95) as m from {z} group by sample)) as sample_p95_abs_z_p50,
 (select round(quantile_cont(m,0.99),6) from (select abs(avg(z)) as m from {z} group by pos)) as gene_mean_abs_z_p99, (select round(max(m),6) from (select abs(avg(z)) as m from {z} group by pos)) as gene_mean_abs_z_max,
 round(avg(case when abs(z)>6 then 1.0 else 0.0 end),6) as abs_z_gt_6_fraction, round(avg(case when abs(z)>10 then 1.0 else 0.0 end),6) as abs_z_gt_10_fraction,
 (select count(*) from (select sum(z*coef) as l from {z} group by sample) where l>=0) as tumor_calls, (select count(*) from (select sum(z*coef) as l from {z} group by sample) where l<0) as normal_calls,
 (select round(quantile_cont(1/(1+exp(-l)),0.5),6) from (select sum(z*coef) as l from {z} group by sample)) as tumor_probability_p50, '{codes}' as message_codes from {z}"""


LOW = "low_model_gene_match,nonfinite_or_missing_values"


@query(
    fx.with_views(
        *BINARY, fx.DEGRADED,
        "z_clean as (select sample, pos, value as raw, (value-mean)/scale as z, coef from expression join (select pos, mean, scale, coef from model) using (pos))",
        "z_degraded as (select 'x'||s.sample as sample, m.pos, d.value as raw, (coalesce(d.value,mean)-mean)/scale as z, coef from (select distinct sample from expression) s cross join model m left join degraded d on d.sample=s.sample and d.pos=m.pos)",
        "z_both as (select * from z_clean union all select * from z_degraded)",
        body=_cohort_report("clean", "z_clean", 64, "PASS", "") + " union all " + _cohort_report("degraded", "z_degraded", 55, "WARN", LOW)
        + " union all " + _cohort_report("compatible_combined", "z_both", 64, "WARN", "nonfinite_or_missing_values"),
    )
)
def qc_reference(spark, sf):
    """Reports of two cohorts with different genes, and of their union."""
    m = fx.binary_model(spark, sf)
    full = fx.expression(spark, sf)
    other = fx.degraded(spark, sf)
    same_names = tuple(fx.GENES[p] for p in fx.DEGRADED_POSITIONS)
    other = type(other)(other.rows.select(F.concat(F.lit("x"), F.col("sample")).alias("sample"), "cells"), same_names)
    return rounded(qc.qc_reference(spark, m, {"clean": full, "degraded": other}, ["clean", "degraded"])).drop("report_json")


@query(
    fx.with_views(
        fx.EXPRESSION, fx.DEGRADED,
        body="""select sample, count(*) as n_genes, count(value) as n_cells, round(sum(value),6) as total from (
 select 'a'||sample as sample, g.gene_id, e.value from (select distinct gene_id from expression union select distinct gene_id from degraded) g cross join (select distinct sample from expression) s left join expression e using (sample, gene_id)
 union all select 'b'||sample, g.gene_id, d.value from (select distinct gene_id from expression union select distinct gene_id from degraded) g cross join (select distinct sample from expression) s left join degraded d using (sample, gene_id)) group by sample""",
    )
)
def union_cohorts(spark, sf):
    a, b = fx.expression(spark, sf), fx.degraded(spark, sf)
    tag = lambda m, t: type(m)(m.rows.select(F.concat(F.lit(t), F.col("sample")).alias("sample"), "cells"), m.genes)
    u = cohort.union_cohorts([tag(a, "a"), tag(b, "b")])
    present = F.filter("cells", lambda v: v.isNotNull())
    return rounded(u.rows.select("sample", F.size("cells").alias("n_genes"), F.size(present).alias("n_cells"), numeric.array_sum(present).alias("total")))


# --- cohort modes ----------------------------------------------------------


@query(
    fx.with_views(
        *DEGRADED_VIEWS,
        body="select pos, count(*) as n, round(avg(x),6) as mean, round(case when stddev_pop(x)=0 then 1 else stddev_pop(x) end,6) as sd from aligned group by pos",
    )
)
def cohort_gene_stats(spark, sf):
    """A gene missing from the input is constant, so its sd becomes 1."""
    stats = adapt.cohort_gene_stats(aligned(spark, sf))
    return rounded(stats.withColumn("sd", F.when(F.col("sd") < 1e-9, 1.0).otherwise(F.col("sd"))))


COHORT_SD = "cohort as (select pos, avg(x) as m, case when stddev_pop(x)<1e-9 then 1 else stddev_pop(x) end as s from aligned group by pos)"


@query(
    fx.with_views(
        *BINARY, fx.DEGRADED, ALIGNED, COHORT_SD,
        "logits as (select sample, sum((x-m)/s*coef) as logit from aligned join cohort using (pos) group by sample)",
        "scored as (select sample, case when logit>=0 then 1/(1+exp(-logit)) else exp(logit)/(1+exp(logit)) end as p from logits)",
        body="select sample, round(p,6) as tumor_probability, case when p>=0.5 then 'tumor' else 'normal' end as call from scored",
    )
)
def cohort_adapt_score(spark, sf):
    return rounded(adapt.cohort_adapt_score(fx.binary_model(spark, sf), fx.degraded(spark, sf), "cohort_zscore", allow_invalid=True))


@query(
    fx.with_views(
        *SCORED,
        "lab as (select sample, y from metadata where is_test)",
        "src as (select 0 as g, y as label, p as score from scored join lab using (sample))",
        "c as (select count(*) filter (where score>=0.5 and label=1) as tp, count(*) filter (where score>=0.5 and label=0) as fp, count(*) filter (where score<0.5 and label=1) as fn, count(*) filter (where score<0.5 and label=0) as tn from src)",
        "a as (select (sum(r) filter (where label=1) - count(*) filter (where label=1)*(count(*) filter (where label=1)+1)/2.0)/(count(*) filter (where label=1)*count(*) filter (where label=0)) as auc from (select label, rank() over (order by score)+(count(*) over (partition by score)-1)/2.0 as r from src))",
        body="""select (select count(*) from scored) as n_samples, (select count(*) from scored where p>=0.5) as tumor_calls, (select count(*) from scored where p<0.5) as normal_calls,
 (select round(quantile_cont(p,0.5),6) from scored) as median_tumor_probability, (select round(auc,4) from a) as auc, round((tp+tn)/cast(tp+tn+fp+fn as double),4) as accuracy,
 round((tp/cast(tp+fn as double)+tn/cast(tn+fp as double))/2,4) as balanced_accuracy, round(tp/cast(tp+fn as double),4) as sensitivity, round(tn/cast(tn+fp as double),4) as specificity from c""",
    )
)
def adaptation_report(spark, sf):
    scores = score_ops.score_binary(fx.binary_model(spark, sf), fx.expression(spark, sf))
    return rounded(adapt.adaptation_report(scores, fx.metadata(spark, sf).where("is_test").select("sample", "label")))


BENCH_VIEWS = """cells as (select project as cohort, sample, y, pos, value, mean, scale, coef from expression join metadata using (sample) join (select pos, mean, scale, coef from model) using (pos)
  union all select 'normals' as cohort, sample, y, pos, value, mean, scale, coef from expression join metadata using (sample) join (select pos, mean, scale, coef from model) using (pos) where y=0),
st as (select cohort, pos, avg(value) as m, case when stddev_pop(value)=0 then 1 else stddev_pop(value) end as s from cells group by cohort, pos),
lg as (select cohort, sample, y, sum((value-mean)/scale*coef) as none, sum((value-m)/s*coef) as cohort_zscore, sum((value-m)/scale*coef) as cohort_center from cells join st using (cohort, pos) group by cohort, sample, y),
src as (select cohort||'|'||mode as g, y as label, 1/(1+exp(-l)) as score from (unpivot lg on none, cohort_zscore, cohort_center into name mode value l)),
rk as (select *, rank() over (partition by g order by score)+(count(*) over (partition by g, score)-1)/2.0 as r from src),
m as (select g, count(*) as n, count(*) filter (where label=1) as p_all, count(*) filter (where label=0) as n_all, sum(case when label=1 then r else 0 end) as rs, count(*) filter (where score>=0.5 and label=1) as tp,
 count(*) filter (where score>=0.5 and label=0) as fp from rk group by g)"""


@query(
    fx.with_views(
        *BINARY, BENCH_VIEWS,
        body="""select split_part(g,'|',1) as cohort, split_part(g,'|',2) as mode, n, case when p_all>0 and n_all>0 then round((rs-p_all*(p_all+1)/2.0)/(p_all*n_all),4) end as auc,
 round((tp+n_all-fp)/cast(n as double),4) as accuracy, case when p_all>0 and n_all>0 then round((tp/cast(p_all as double)+(n_all-fp)/cast(n_all as double))/2,4) end as balanced_accuracy,
 round(case when n_all>0 then fp/cast(n_all as double) end,4) as fpr from m""",
    )
)
def adaptation_benchmark(spark, sf):
    """Each project is a cohort; all normals together are a one-class cohort."""
    from ..sources.matrix import ExpressionMatrix

    model = fx.binary_model(spark, sf)
    rows = fx.labelled_expression(spark, sf).rows.withColumn("label", F.col("y"))
    projects = [r[0] for r in rows.select("project").distinct().orderBy("project").collect()]
    pick = lambda cond: align_ops.align(ExpressionMatrix(rows.where(cond), fx.GENES), model, keep=["label"])
    cohorts = {p: pick(F.col("project") == p) for p in projects}
    cohorts["normals"] = pick(F.col("label") == 0)
    return adapt.adaptation_benchmark(cohorts)


@query(
    fx.with_views(
        *BINARY,
        "fr as (select unnest([0.1,0.25,0.5,0.75,0.9]::double[]) as fraction)",
        """plan as (select fraction, rep, draw, case when draw<greatest(1,least(79,cast(round(fraction*80) as int))) then 1 else 0 end as label
  from fr, (select unnest(range(0,200)) as rep), (select unnest(range(0,80)) as draw))""",
        "ranked as (select sample, y as label, row_number() over (partition by y order by md5('0:'||sample), sample)-1 as at from metadata)",
        "sizes as (select y as label, count(*) as size from metadata group by y)",
        """picked as (select p.fraction, p.rep, p.draw, p.label, r.sample from plan p join sizes s using (label) join ranked r
  on r.label=p.label and r.at=cast('0x'||substr(md5('0:'||p.fraction||':'||p.rep||':'||p.draw),1,12) as bigint)%s.size)""",
        "cells as (select p.*, e.pos, e.value from picked p join expression e using (sample))",
        "st as (select fraction, rep, pos, avg(value) as m, case when stddev_pop(value)=0 then 1 else stddev_pop(value) end as s from cells group by fraction, rep, pos)",
        """logits as (select fraction, rep, draw, any_value(label) as label, sum((value-mean)/scale*coef) as deployed, sum((value-m)/s*coef) as adapted
  from cells join st using (fraction, rep, pos) join model using (pos) group by fraction, rep, draw)""",
        "acc as (select fraction, rep, (avg((deployed>=0)::int) filter (where label=1)+avg((deployed<0)::int) filter (where label=0))/2 as bd, (avg((adapted>=0)::int) filter (where label=1)+avg((adapted<0)::int) filter (where label=0))/2 as ba from logits group by fraction, rep)",
        "src as (select fraction||':'||rep as g, fraction, rep, label, adapted as score from logits)", RANKS,
        body="""select a.fraction as tumor_fraction, 80 as cohort_n, round(round(avg(bd),10),4) as balanced_acc_deployed, round(round(avg(ba),10),4) as balanced_acc_adapted, round(round(avg(auc),10),4) as auc_adapted
 from acc a join auc on g=a.fraction||':'||a.rep group by a.fraction""",
    )
)
def composition_bootstrap(spark, sf):
    from ..sources.matrix import ExpressionMatrix

    rows = fx.labelled_expression(spark, sf).rows.withColumn("label", F.col("y"))
    a = align_ops.align(ExpressionMatrix(rows, fx.GENES), fx.binary_model(spark, sf), keep=["label"])
    return adapt.composition_bootstrap(a)
