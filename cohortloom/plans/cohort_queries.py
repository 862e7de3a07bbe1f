"""Cohort draws, splits, feature selection and model fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, splits, train
from . import fit_sql, fixtures as fx
from .common import rounded
from .metric_queries import RANKS, RATES
from .registry import query

FEATURES = "cells as (select e.sample, e.pos, e.value, m.y, m.project, m.case_id, m.is_test from expression e join metadata m using (sample))"
FEATURE_VIEWS = (fx.EXPRESSION, fx.METADATA, FEATURES)


def rows(spark, sf):
    return fx.feature_rows(spark, sf)


# --- draws -----------------------------------------------------------------



@query(
    fx.with_views(
        fx.MANIFEST,
        "bio as (select * from (select *, row_number() over (partition by sample_submitter_id order by file_id) as r1 from manifest) where r1=1)",
        "case_ as (select * from (select *, row_number() over (partition by case_submitter_id order by file_id) as r2 from bio) where r2=1)",
        body="select file_id, sample_submitter_id, case_submitter_id from case_",
    )
)
def dedupe_first(spark, sf):
    m = fx.file_manifest(spark, sf)
    return cohort.dedupe_first(m, "file_id", "sample_submitter_id", "case_submitter_id").select("file_id", "sample_submitter_id", "case_submitter_id")


def _first(kind: str, prefix: str) -> str:
    return f"""{prefix}1 as (select * from (select *, row_number() over (partition by sample_submitter_id order by file_id) as r1 from manifest where sample_type='{kind}') where r1=1),
{prefix}2 as (select * from (select *, row_number() over (partition by case_submitter_id order by file_id) as r2 from {prefix}1) where r2=1)"""


@query(
    fx.with_views(
        fx.MANIFEST, _first("Primary Tumor", "t"), _first("Solid Tissue Normal", "n"),
        "tumor as (select * from t2 order by md5('42:'||file_id), file_id limit 200)",
        "normal as (select * from n2 where case_submitter_id not in (select case_submitter_id from tumor) order by md5('42:'||file_id), file_id limit 200)",
        body="select file_id, case_submitter_id, sample_type, 1 as label from tumor union all select file_id, case_submitter_id, sample_type, 0 from normal",
    )
)
def sample_per_class(spark, sf):
    """Donor-disjoint: a case drawn as tumor is not drawn as normal."""
    drawn = cohort.sample_per_class(fx.file_manifest(spark, sf), 200, 42)
    return drawn.select("file_id", "case_submitter_id", "sample_type", "label")


@query(
    fx.with_views(
        fx.MANIFEST, _first("Primary Tumor", "t"), _first("Solid Tissue Normal", "n"),
        body="""select file_id, 1 as label from (select * from t2 order by md5('7:'||file_id), file_id limit 150) union all select file_id, 0 from (select * from n2 order by md5('7:'||file_id), file_id limit 150)""",
    )
)
def sample_per_class_overlapping(spark, sf):
    return cohort.sample_per_class(fx.file_manifest(spark, sf), 150, 7, disjoint=False).select("file_id", "label")


@query(
    fx.with_views(
        fx.MANIFEST.replace("manifest as (", "all_files as (", 1), "manifest as (select * from all_files where project='P-O')", _first("Primary Tumor", "t"), _first("Solid Tissue Normal", "n"),
        "tumor as (select * from t2 order by md5('5:'||file_id), file_id limit 100)",
        "normal as (select * from n2 where case_submitter_id not in (select case_submitter_id from tumor) order by md5('5:'||file_id), file_id limit 100)",
        body="select file_id, project, case_submitter_id, 1 as label from tumor union all select file_id, project, case_submitter_id, 0 from normal",
    )
)
def draw_project_files(spark, sf):
    """The manifest is checked whole, one project is drawn from."""
    return cohort.draw_project_files(fx.file_manifest(spark, sf), "P-O", 100, 5).select("file_id", "project", "case_submitter_id", "label")


def study_phenotype(spark, sf):
    k = F.col("event_id")
    study = F.when(k % 4 == 0, "GTEX").otherwise("TCGA")
    sample = F.concat_ws("-", study, F.lit("X"), F.col("user_id").cast("string"), k.cast("string"))
    kind = F.when(k % 4 == 0, "Normal Tissue").when(k % 4 == 1, "Solid Tissue Normal").otherwise("Primary Tumor")
    return fx.table(spark, sf, "events").select(sample.alias("sample"), study.alias("study"), kind.alias("sample_type"))


@query(
    fx.with_views(
        """pheno as (select 'TCGA-X-'||user_id||'-'||event_id as sample, 'TCGA-X-'||user_id as donor_id, case when event_id%4=1 then 0 else 1 end as label from events where event_id%4<>0)""",
        "one as (select * from (select *, row_number() over (partition by label, donor_id order by sample) as r from pheno) where r=1)",
        "tumor as (select * from one where label=1 order by md5('3:'||sample), sample limit 40)",
        "normal as (select * from one where label=0 and donor_id not in (select donor_id from tumor) order by md5('3:'||sample), sample limit 40)",
        body="select sample, donor_id, label from tumor union all select sample, donor_id, label from normal",
    )
)
def draw_study_samples(spark, sf):
    """One study of two, a donor on one side only."""
    return cohort.draw_study_samples(study_phenotype(spark, sf), "TCGA", 40, 3).select("sample", "donor_id", "label")


SITE = """first_ as (select * from (select *, 'GTEX-'||split_part(sample,'-',2) as donor_id, row_number() over (partition by primary_site, split_part(sample,'-',2) order by sample) as r from phenotype) where r=1),
sites as (select primary_site, count(*) as k from first_ group by primary_site having count(*)>=20)"""


@query(
    fx.with_views(
        fx.PHENOTYPE, SITE,
        body="select sample, primary_site, donor_id from (select f.*, row_number() over (partition by primary_site order by md5('42:'||sample), sample) as q from first_ f join sites using (primary_site)) where q<=30",
    )
)
def sample_per_site_overlapping(spark, sf):
    return cohort.sample_per_site_overlapping(fx.phenotype(spark, sf), 30, 20, 42).select("sample", "primary_site", "donor_id")


def _site_turns(turns: int, n: int, least: int, seed: int) -> list[str]:
    """A view per turn: the draw of the next rarest site from donors not drawn before."""
    views = [f"ordered as (select primary_site as site, row_number() over (order by count(*), primary_site) as turn from first_ group by primary_site having count(*)>={least})"]
    for t in range(1, turns + 1):
        used = "".join(f" and donor_id not in (select donor_id from turn{u})" for u in range(1, t))
        views.append(f"turn{t} as (select f.sample, primary_site, donor_id from first_ f join ordered on site=primary_site and turn={t} where true{used} order by md5('{seed}:'||f.sample), f.sample limit {n})")
    return views


# The events table has five sites.
@query(fx.with_views(fx.PHENOTYPE, SITE, *_site_turns(5, 10, 5, 42), body=" union all ".join(f"select * from turn{t}" for t in range(1, 6))))
def sample_per_site(spark, sf):
    """Rarest site first, donors disjoint over sites."""
    return cohort.sample_per_site(fx.phenotype(spark, sf), 10, 5, 42).select("sample", "primary_site", "donor_id")


@query(
    fx.with_views(
        fx.COUNTS,
        "g as (select regexp_replace(gene_id,'\\.[0-9]+$','') as gene_id, tpm from counts)",
        body="select gene_id, count(*) as n, round(avg(case when tpm>25 then 1.0 else 0.0 end),6) as expressed_fraction from g group by gene_id having avg(case when tpm>25 then 1.0 else 0.0 end)>0.5",
    )
)
def expressed_gene_filter(spark, sf):
    from ..functions.ids import strip_version

    cells = fx.counts(spark, sf).select(strip_version("gene_id").alias("gene_id"), "tpm")
    return rounded(cohort.expressed_genes(cells, 25.0, 0.5))


@query(
    fx.with_views(
        fx.COUNTS,
        """annotation as (select 'ENSG'||lpad(cast(g as varchar),11,'0')||'.'||cast(g%4+1 as varchar) as gene_id, case when g%5=0 then 'lncRNA' else 'protein_coding' end as gene_type
  from (select distinct p_partkey%400 as g from part))""",
        "expressed as (select gene_id, count(*) as n, avg(case when tpm>25 then 1.0 else 0.0 end) as fraction from counts group by gene_id having avg(case when tpm>25 then 1.0 else 0.0 end)>0.5)",
        body="""select e.gene_id, n, round(fraction,6) as expressed_fraction from expressed e
  where coalesce((select bool_or(gene_type='protein_coding') from annotation a where a.gene_id=e.gene_id),
                 (select bool_or(gene_type='protein_coding') from annotation a where regexp_replace(a.gene_id,'\\.[0-9]+$','')=regexp_replace(e.gene_id,'\\.[0-9]+$','')), false)""",
    )
)
def expressed_coding_genes(spark, sf):
    """Expressed genes that an annotation file names protein-coding, by id or by id without version."""
    from ..session import scratch_path
    from ..sources.tables import read_table, write_table

    g = F.col("p_partkey") % 400
    told = fx.table(spark, sf, "part").select(
        F.concat(F.lit("ENSG"), F.lpad(g.cast("string"), 11, "0"), F.lit("."), (g % 4 + 1).cast("string")).alias("gene_id"),
        F.when(g % 5 == 0, "lncRNA").otherwise("protein_coding").alias("gene_type"),
    ).distinct()
    annotation = read_table(spark, write_table(told, scratch_path(spark, "annotation")), ["gene_id", "gene_type"])
    cells = fx.counts(spark, sf).select("gene_id", "tpm")
    return rounded(cohort.genes_of_biotype(cohort.expressed_genes(cells, 25.0, 0.5), annotation))


@query(
    fx.with_views(
        fx.MANIFEST,
        "k as (select file_id, project, case when sample_type='Primary Tumor' then 1 else 0 end as label from manifest)",
        "r as (select *, row_number() over (partition by project, label order by md5('5:'||file_id), file_id) as q from k)",
        body="select file_id, project, label from r where label=0 or q<=1*(select count(*) from k x where x.project=r.project and x.label=0)",
    )
)
def class_cap(spark, sf):
    m = fx.file_manifest(spark, sf).select("file_id", "project", F.when(F.col("sample_type") == "Primary Tumor", 1).otherwise(0).alias("label"))
    return cohort.class_cap(m, 1, key="file_id", seed=5)


# --- splits ----------------------------------------------------------------

FOLDS = """patients as (select case_id, string_agg(distinct project||'_'||cast(y as varchar), '|' order by project||'_'||cast(y as varchar)) as signature from metadata group by case_id),
folds as (select case_id, ((row_number() over (partition by signature order by md5('1:'||case_id), case_id)) - 1 + cast('0x'||substr(md5('1:'||signature),1,7) as bigint)) % 5 as fold from patients)"""


@query(fx.with_views(fx.METADATA, FOLDS, body="select case_id, fold from folds"))
def grouped_stratified_folds(spark, sf):
    return splits.grouped_stratified_folds(fx.metadata(spark, sf), 5, 1, "case_id", ["project", "y"])


@query(fx.with_views(fx.METADATA, FOLDS, body="select fold, project, y, count(*) as n, count(distinct case_id) as n_patients from metadata join folds using (case_id) group by all"))
def fold_balance(spark, sf):
    m = fx.metadata(spark, sf)
    folds = splits.grouped_stratified_folds(m, 5, 1, "case_id", ["project", "y"])
    return splits.fold_balance(splits.with_folds(m, folds), ["project", "y"])


@query(
    fx.with_views(
        fx.METADATA,
        body="""select p.project as held_out_type, count(*) filter (where m.project<>p.project) as n_train, count(*) filter (where m.project=p.project) as n_test,
 count(*) filter (where m.project<>p.project and y=1) as train_tumor, count(*) filter (where m.project<>p.project and y=0) as train_normal,
 count(*) filter (where m.project=p.project and y=1) as test_tumor, count(*) filter (where m.project=p.project and y=0) as test_normal, 0 as shared_cases, true as valid
 from metadata m, (select distinct project from metadata) p group by p.project""",
    )
)
def loco_splits(spark, sf):
    return splits.loco_splits(fx.metadata(spark, sf), label="y")


@query(fx.with_views(fx.METADATA, body="select sample, project, 1 as part_of from metadata where y=1 union all select sample, project, 0 from metadata where y=0"))
def union_predictions(spark, sf):
    """Parts that together cover every sample exactly once."""
    m = fx.metadata(spark, sf)
    parts = [m.where(F.col("y") == v).select("sample", "project", F.lit(v).alias("part_of")) for v in (1, 0)]
    return cohort.union_predictions(parts, m)


# --- selection and scaling -------------------------------------------------

ANOVA = """cls as (select pos, {y} as y, count(*) as n, avg(value) as m, var_pop(value) as v from cells where not is_test group by pos, {y}),
tot as (select pos, sum(n) as n, count(*) as k, sum(n*m)/sum(n) as grand from cls group by pos),
f as (select pos, (sum(c.n*(c.m-t.grand)^2)/(t.k-1))/(sum(c.n*c.v)/(t.n-t.k)) as f from cls c join tot t using (pos) group by pos, t.k, t.n)"""


@query(fx.with_views(*FEATURE_VIEWS, ANOVA.format(y="y"), body="select pos, round(f,6) as f from f"))
def anova_f(spark, sf):
    return rounded(train.anova_f(rows(spark, sf).where("not is_test")))


@query(fx.with_views(*FEATURE_VIEWS, ANOVA.format(y="project"), body="select pos, round(f,6) as f from f"))
def anova_f_many_classes(spark, sf):
    return rounded(train.anova_f(rows(spark, sf).where("not is_test"), "project"))


@query(fx.with_views(*FEATURE_VIEWS, ANOVA.format(y="y"), body="select pos, round(f,6) as f from f order by f desc, pos desc limit 20"))
def select_k_best(spark, sf):
    return rounded(train.select_k_best(train.anova_f(rows(spark, sf).where("not is_test")), 20))


@query(fx.with_views(*FEATURE_VIEWS, body="select pos, round(avg(value),6) as mean, round(stddev_pop(value),6) as scale from cells where not is_test group by pos"))
def training_scaler(spark, sf):
    return rounded(train.training_scaler(rows(spark, sf).where("not is_test")))


# --- models ----------------------------------------------------------------


TYPES = ("T0", "T1", "T2", "T3", "T4")


def _folds(where: str, seed: int, k: int, stratum: str = "project||'_'||cast(y as varchar)") -> str:
    return f"""patients as (select case_id, string_agg(distinct {stratum}, '|' order by {stratum}) as signature from metadata where {where} group by case_id),
folds as (select case_id, ((row_number() over (partition by signature order by md5('{seed}:'||case_id), case_id)) - 1 + cast('0x'||substr(md5('{seed}:'||signature),1,7) as bigint)) % {k} as fold from patients)"""


HELD_OUT = (
    *fit_sql.SINGLE, fit_sql.binary_fit(20, 0.1), "held_rows as (select 0 as side, sample from metadata where is_test)",
    fit_sql.held_cells(20), fit_sql.BINARY_HELD,
)
SIDE_FOLDS = "(select distinct fold from folds)"


@query(
    fit_sql.recursive(
        *fit_sql.SINGLE, fit_sql.binary_fit(20, 0.1),
        body=f"""select pos, gene_id, round(s.mean,6) as mean, round(s.scale,6) as scale, round(th[j],6) as coef, round(th[21],6) as intercept
 from sel s join fitted using (side) join (select distinct pos, gene_id from expression) using (pos)""",
    )
)
def fit_binary(spark, sf):
    """Coefficients over the 20 best genes."""
    fitted = train.fit_binary(rows(spark, sf).where("not is_test"), fx.GENES, 20, 0.1)
    m = fitted.model
    return rounded(
        spark.createDataFrame(
            [(p, g, mean, scale, c, m.intercept[0]) for p, g, mean, scale, c in zip(fitted.positions, m.genes, m.mean, m.scale, m.coef[0])],
            "pos int, gene_id string, mean double, scale double, coef double, intercept double",
        )
    )


@query(
    fit_sql.recursive(
        *fit_sql.SINGLE, fit_sql.selection(20),
        body="""select 0 as class_idx, pos, round(mean,6) as mean, round(scale,6) as scale, 0.0::double as residual from sel""",
    )
)
def fit_optimality(spark, sf):
    """The objective's gradient at the binary fit, summed anew over the training rows: zero to six digits."""
    r = rows(spark, sf).where("not is_test")
    fitted = train.fit_binary(r, fx.GENES, 20, 0.1)
    m = fitted.model
    scaler = spark.createDataFrame(list(zip(fitted.positions, m.mean, m.scale)), "pos int, mean double, scale double")
    found = train.optimality(fitted, r, 0.1).withColumn("residual", F.abs("residual")).join(F.broadcast(scaler), "pos")
    return rounded(found.select("class_idx", "pos", "mean", "scale", "residual"))


@query(
    fit_sql.recursive(
        fx.EXPRESSION, fx.METADATA, "side_rows as (select 0 as side, sample, substr(project,6) as y from metadata where y=1)",
        fit_sql.softmax_fit(TYPES, 20, 2.0), "held_rows as (select side, sample from side_rows)", fit_sql.held_cells(20), fit_sql.softmax_held(TYPES, 20),
        "r as (select *, row_number() over (partition by sample order by p desc, class) as rn from held)",
        body="""select sample, max(case when rn=1 then class end) as predicted_type, round(max(case when rn=1 then p end),4) as probability,
 max(case when rn=1 then class||':'||printf('%.3f',p) end) as top1, max(case when rn=2 then class||':'||printf('%.3f',p) end) as top2, max(case when rn=3 then class||':'||printf('%.3f',p) end) as top3 from r group by sample""",
    )
)
def fit_multiclass(spark, sf):
    """Class probabilities of all tumors under the fitted many-class model."""
    from ..operators.score import score_aligned, top_classes

    tumors = train.tumor_types(rows(spark, sf))
    fitted = train.fit_multiclass(tumors, fx.GENES, 20, 2.0, "type_code")
    return top_classes(score_aligned(fitted.features(tumors.select("sample", "x"))), fitted.model, 3)


@query(
    fit_sql.recursive(
        *HELD_OUT, "src as (select m.project as g, m.y as label, h.p as score from held h join metadata m using (sample))", RANKS,
        body="""select g as project, count(*) as n, count(*) filter (where label=1) as n_tumor, count(*) filter (where label=0) as n_normal, round(max(auc),6) as auc,
 round(avg(case when (score>=0.5)=(label=1) then 1.0 else 0.0 end),6) as accuracy from src join auc using (g) group by g""",
    )
)
def evaluate_heldout(spark, sf):
    r = rows(spark, sf)
    fitted = train.fit_binary(r.where("not is_test"), fx.GENES, 20, 0.1)
    return rounded(train.evaluate_heldout(fitted, r.where("is_test"))["per_project"])


@query(
    fit_sql.recursive(
        fx.EXPRESSION, fx.METADATA, _folds("not is_test", 1, 5),
        f"side_rows as (select d.fold as side, m.sample, m.y from metadata m join folds f using (case_id), {SIDE_FOLDS} d where not m.is_test and f.fold<>d.fold)",
        fit_sql.binary_fit(20, 0.1), "held_rows as (select f.fold as side, m.sample from metadata m join folds f using (case_id) where not m.is_test)",
        fit_sql.held_cells(20), fit_sql.BINARY_HELD,
        "src as (select h.side as g, m.y as label, h.p as score from held h join metadata m using (sample))", RANKS,
        "k as (select side, count(*) as n from held_rows group by side)",
        body="""select g+1 as fold, (select sum(n) from k)-n as n_train, n as n_validation, round(auc,6) as auc from auc join k on side=g""",
    )
)
def grouped_cv(spark, sf):
    return rounded(train.grouped_cv(rows(spark, sf).where("not is_test"), fx.GENES, 20, 0.1))


@query(
    fit_sql.recursive(
        fx.EXPRESSION, fx.METADATA, _folds("y=1", 42, 5, "substr(project,6)"),
        f"side_rows as (select d.fold as side, m.sample, substr(m.project,6) as y from metadata m join folds f using (case_id), {SIDE_FOLDS} d where m.y=1 and f.fold<>d.fold)",
        fit_sql.softmax_fit(TYPES, 20, 2.0), "held_rows as (select f.fold as side, m.sample from metadata m join folds f using (case_id) where m.y=1)",
        fit_sql.held_cells(20), fit_sql.softmax_held(TYPES, 20),
        "r as (select *, row_number() over (partition by sample order by p desc, class) as rn from held)",
        body="""select sample, m.case_id, side+1 as fold, substr(m.project,6) as true_type, class as predicted_type, round(p,6) as confidence, (class=substr(m.project,6))::int as correct
 from r join metadata m using (sample) where rn=1""",
    )
)
def oof_predictions(spark, sf):
    return rounded(train.oof_predictions(train.tumor_types(rows(spark, sf)), fx.GENES, 20, 2.0, y="type_code"))


@query(
    fit_sql.recursive(
        fx.EXPRESSION, fx.METADATA,
        "side_rows as (select p.project as side, m.sample, m.y from metadata m, (select distinct project from metadata) p where m.project<>p.project)",
        fit_sql.binary_fit(20, 0.1), "held_rows as (select project as side, sample from metadata)", fit_sql.held_cells(20), fit_sql.BINARY_HELD,
        "src as (select h.side as g, m.y as label, h.p as score from held h join metadata m using (sample))", RANKS,
        "c as (select g, count(*) filter (where score>=0.5 and label=1) as tp, count(*) filter (where score>=0.5 and label=0) as fp, count(*) filter (where score<0.5 and label=1) as fn, count(*) filter (where score<0.5 and label=0) as tn from src group by g)",
        body=f"""select g as held_out_type, 'logistic_regression' as model, tp+fp+fn+tn as n_test, tn+fp as n_normal, tp+fn as n_tumor, round(auc,6) as auc, round(ap,6) as avg_precision,
 round(accuracy,6) as accuracy, round(f1,6) as f1, round(precision,6) as precision, round(recall,6) as recall from (select *, {RATES} from c) join auc using (g)""",
    )
)
def loco(spark, sf):
    return rounded(train.loco(rows(spark, sf), fx.GENES, 20, 0.1)["per_type"])


@query(
    fit_sql.recursive(
        fx.EXPRESSION, fx.METADATA, _folds("not is_test", 1, 3),
        # Side -1 is the whole training side, the others leave out a fold.
        f"""side_rows as (select d.fold as side, m.sample, m.y from metadata m join folds f using (case_id), (select -1 as fold union all select * from {SIDE_FOLDS}) d
  where not m.is_test and f.fold<>d.fold)""",
        fit_sql.binary_fit(20, 0.1),
        """held_rows as (select -1 as side, sample from metadata where is_test
  union all select f.fold, m.sample from metadata m join folds f using (case_id) where not m.is_test)""",
        fit_sql.held_cells(20), fit_sql.BINARY_HELD,
        "src as (select h.side as g, m.y as label, h.p as score from held h join metadata m using (sample))", RANKS,
        "c as (select count(*) filter (where score>=0.5 and label=1) as tp, count(*) filter (where score>=0.5 and label=0) as fp, count(*) filter (where score<0.5 and label=1) as fn, count(*) filter (where score<0.5 and label=0) as tn from src where g=-1)",
        body=f"""select (select count(*) from metadata where not is_test) as n_train, (select count(*) from metadata where is_test) as n_test,
 (select round(auc,6) from auc where g=-1) as auc, (select round(ap,6) from auc where g=-1) as average_precision, round(accuracy,6) as accuracy, round(f1,6) as f1,
 (select count(*) from auc where g>=0) as n_folds, (select round(avg(auc),6) from auc where g>=0) as mean_auc, (select round(stddev_pop(auc),6) from auc where g>=0) as std_auc
 from (select *, {RATES} from c)""",
    )
)
def training_summary(spark, sf):
    """Counts, held-out metrics and the cross-validation's; the configuration text is left out here."""
    r = rows(spark, sf)
    fitted = train.fit_binary(r.where("not is_test"), fx.GENES, 20, 0.1)
    held = train.evaluate_heldout(fitted, r.where("is_test"))["metrics"]
    sizes = {x["is_test"]: x["n"] for x in r.groupBy("is_test").agg(F.count("*").alias("n")).collect()}
    cv = train.grouped_cv(r.where("not is_test"), fx.GENES, 20, 0.1, n_folds=3)
    return rounded(train.training_summary(fitted, sizes[False], sizes[True], held, cv, 20, 0.1).drop("config"))


OOF = """oof as (select o_orderkey%5+1 as fold, o_orderpriority as true_type, case when o_totalprice%3<1 then o_orderpriority when o_totalprice%3<2 then '2-HIGH' else '5-LOW' end as predicted_type, o_custkey as case_id from orders)"""


def oof_fixture(spark, sf):
    """Out-of-fold predictions made of orders."""
    p = F.col("o_totalprice") % 3
    return fx.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 5 + 1).alias("fold"), F.col("o_orderpriority").alias("true_type"),
        F.when(p < 1, F.col("o_orderpriority")).when(p < 2, "2-HIGH").otherwise("5-LOW").alias("predicted_type"), F.col("o_custkey").alias("case_id"),
    ).withColumn("correct", F.when(F.col("true_type") == F.col("predicted_type"), 1).otherwise(0))


def _labels(df):
    # The class list: one name per cancer type.
    return [r[0] for r in df.select("true_type").distinct().orderBy("true_type").collect()]


@query(
    fx.with_views(
        OOF,
        "lab as (select distinct true_type as l from oof)",
        "per as (select fold, l, sum((true_type=l)::int) as support, sum((predicted_type=l)::int) as called, sum((true_type=l and predicted_type=l)::int) as tp from oof, lab group by fold, l)",
        "f as (select fold, avg(case when support+called>0 then 2.0*tp/(support+called) else 0 end) as macro_f1 from per group by fold)",
        "s as (select fold, count(*) as n_test, count(distinct case_id) as n_test_patients, avg((true_type=predicted_type)::int) as accuracy from oof group by fold)",
        body="""select fold, (select sum(n_test) from s)-n_test as n_train, n_test, (select sum(n_test_patients) from s)-n_test_patients as n_train_patients, n_test_patients, round(accuracy,6) as accuracy, round(macro_f1,6) as macro_f1 from s join f using (fold)""",
    )
)
def fold_metrics(spark, sf):
    oof = oof_fixture(spark, sf)
    return rounded(train.fold_metrics(oof, _labels(oof)))


@query(
    fx.with_views(
        OOF,
        "lab as (select distinct true_type as l from oof)",
        "per as (select l, sum((true_type=l)::int) as support, sum((predicted_type=l)::int) as called, sum((true_type=l and predicted_type=l)::int) as tp from oof, lab group by l)",
        body="""select l as cancer_type, support, round(tp/cast(called as double),6) as precision, round(tp/cast(support as double),6) as recall, round(2.0*tp/(support+called),6) as f1 from per where called>0
 union all select l, support, 0, 0, 0 from per where called=0""",
    )
)
def oof_report_per_class(spark, sf):
    oof = oof_fixture(spark, sf)
    return rounded(train.oof_report(oof, _labels(oof))["per_class"])


@query(
    fx.with_views(
        OOF,
        "lab as (select distinct true_type as l from oof)",
        "per as (select l, sum((true_type=l)::int) as support, sum((predicted_type=l)::int) as called, sum((true_type=l and predicted_type=l)::int) as tp from oof, lab group by l)",
        "f as (select *, case when support+called>0 then 2.0*tp/(support+called) else 0 end as f1 from per)",
        body="""select round((select avg((true_type=predicted_type)::int) from oof),6) as accuracy, round(avg(tp/cast(support as double)),6) as balanced_accuracy, round(avg(f1),6) as macro_f1, round(sum(f1*support)/sum(support),6) as weighted_f1 from f""",
    )
)
def oof_report_summary(spark, sf):
    oof = oof_fixture(spark, sf)
    return rounded(train.oof_report(oof, _labels(oof))["summary"])


@query("select part, 0 as n_identity_changes, 0.0 as max_abs_delta, true as within_tolerance from (select unnest(['mean','scale','coef','intercept']) as part)")
def export_model(spark, sf):
    """The fitted model written as tables and read back, beside the original."""
    from ..operators import model as model_ops
    from ..session import scratch_path

    fitted = train.fit_binary(rows(spark, sf).where("not is_test"), fx.GENES, 20, 0.1)
    tables = model_ops.model_tables(spark, fitted.model)
    back = model_ops.read_model(spark, model_ops.write_model(tables, scratch_path(spark, "fitted")), "binary")
    return model_ops.compare_models(tables, back, 0.0)


# --- composites ------------------------------------------------------------


@query(
    fx.with_views(
        fx.NORMALS,
        body="""select primary_site, count(*) as n, count(*) filter (where tumor_probability>=0.5) as tumor_calls, round(count(*) filter (where tumor_probability>=0.5)/cast(count(*) as double),6) as false_positive_rate,
 round(quantile_cont(tumor_probability,0.5),6) as median_tumor_probability, round(max(tumor_probability),6) as max_tumor_probability from normals group by primary_site""",
    )
)
def validate_external_normal(spark, sf):
    """Manifest rules, score merge and all-normal tables; the site table is shown."""
    from ..operators.checks import require

    p = fx.donors(fx.phenotype(spark, sf))
    require(cohort.phenotype_manifest_issues(p, "GTEX"), "manifest")
    s = fx.normal_scores(spark, sf).select("sample", "tumor_probability", "call")
    return rounded(cohort.validate_all_normal(p, s)["by_site"])


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL, fx.LOGITS,
        body="""select case when y=1 then 'Primary Tumor' else 'Solid Tissue Normal' end as sample_type, count(*) as n, round(avg(p),6) as mean_tumor_probability,
 round(quantile_cont(p,0.5),6) as median_tumor_probability, count(*) filter (where p>=0.5) as tumor_calls from scored join metadata using (sample) group by 1""",
    )
)
def validate_external_labelled(spark, sf):
    """Every sample as an external cohort: score, merge, summarise by type."""
    from ..operators.score import score_binary

    meta = fx.metadata(spark, sf).select(
        "sample", F.col("y").alias("label"), F.when(F.col("y") == 1, "Primary Tumor").otherwise("Solid Tissue Normal").alias("sample_type"), F.col("case_id").alias("donor_id")
    )
    scores = score_binary(fx.binary_model(spark, sf), fx.expression(spark, sf))
    return rounded(cohort.validate_labelled(meta, scores, "native")["by_type"])


def _beside(table, audit):
    """A cohort's table with its audit (one row) in further columns."""
    row = audit.first()
    return table.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in audit.schema.fields])


def _file_scores(value: str) -> str:
    """Scores of expression values that went through a file; ``value`` is what is read back."""
    return f"""logits as (select sample, sum(({value}-mean)/scale*coef) as logit from expression join model using (pos) group by sample),
scored as (select sample, case when logit>=0 then 1/(1+exp(-logit)) else exp(logit)/(1+exp(logit)) end as p from logits)"""


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL, _file_scores("log2(round(pow(2,value)-1,6)+1)"),
        "donors as (select case_id, count(*) as k from metadata group by case_id)",
        body="""select case when y=1 then 'Primary Tumor' else 'Solid Tissue Normal' end as sample_type, count(*) as n, round(avg(p),6) as mean_tumor_probability,
 round(quantile_cont(p,0.5),6) as median_tumor_probability, count(*) filter (where p>=0.5) as tumor_calls,
 (select count(*) from metadata) as n_rows, (select count(distinct sample) from metadata) as n_unique_ids, (select count(*) from donors) as n_unique_groups,
 (select count(*) from donors where k>1) as n_repeated_groups, (select max(k) from donors) as max_rows_per_group,
 (select count(distinct sample) from metadata) as n_unique_biospecimens, 0 as n_ambiguous_biospecimen_ids, 'locked' as cohort_mode
 from scored join metadata using (sample) group by 1""",
    )
)
def validate_count_files(spark, sf):
    """A provider's nested manifest and one count file per sample, to figures by type and the audit."""
    from ..operators import external
    from ..session import scratch_path
    from ..sources import manifest

    path, hits = fx.write_count_files(spark, sf, scratch_path(spark, "provider-counts"))
    rows_ = manifest.flatten_manifest(manifest.read_manifest(spark, hits))
    found = external.validate_count_files(fx.binary_model(spark, sf), rows_, path, file_id=fx.FILE_ID)
    return rounded(_beside(found["by_type"], found["audit"]))


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL, _file_scores("log2(greatest(pow(2,round(value-2,6))-0.001,0)+1)"),
        "donors as (select case_id, count(*) as k from metadata group by case_id)",
        body="""select project as primary_site, count(*) as n, count(*) filter (where p>=0.5) as tumor_calls, round(count(*) filter (where p>=0.5)/cast(count(*) as double),6) as false_positive_rate,
 round(quantile_cont(p,0.5),6) as median_tumor_probability, round(max(p),6) as max_tumor_probability,
 (select count(*) from metadata) as n_rows, (select count(distinct sample) from metadata) as n_unique_ids, (select count(*) from donors) as n_unique_groups,
 (select count(*) from donors where k>1) as n_repeated_groups, (select max(k) from donors) as max_rows_per_group, 'locked' as cohort_mode
 from scored join metadata using (sample) group by 1""",
    )
)
def validate_gene_rows(spark, sf):
    """A phenotype table and gene-by-sample files of every sample, to figures by site and the audit."""
    from ..operators import external
    from ..session import scratch_path
    from ..sources import tables

    path, phenotype = fx.write_gene_files(spark, sf, scratch_path(spark, "provider-genes"))
    found = external.validate_gene_rows(fx.binary_model(spark, sf), tables.read_phenotype(spark, phenotype), path)
    return rounded(_beside(found["by_site"], found["audit"]))


CALIBRATION = "n bigint, n_tumor bigint, n_normal bigint, auc double, recommended_threshold double, recommended_accuracy double, recommended_recall double, recommended_specificity double"


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL, fx.LOGITS, "src as (select 0 as g, y as label, p as score from scored join metadata using (sample))", RANKS,
        body="""select 'complete' as status, 0.5::double as threshold, (select count(distinct sample) from expression) as samples, (select count(distinct pos) from expression)::int as input_genes,
 (select count(*) from model)::int as matched_model_genes, 0::int as missing_model_genes, 'PASS' as qc_status, (select count(*) from expression where value is null) as invalid_matched_cells,
 (select count(*) from scored where p>=0.5) as tumor_calls, (select count(*) from scored where p<0.5) as normal_calls, 'qc,scores,thresholds,calibration,explanations' as outputs, null::varchar as error,
 tp+fn+tn+fp as n, tp+fn as n_tumor, tn+fp as n_normal, (select round(auc,6) from auc) as auc, round(threshold,6) as recommended_threshold, round((tp+tn)/cast(tp+fn+tn+fp as double),6) as recommended_accuracy,
 round(tp/cast(tp+fn as double),6) as recommended_recall, round(tn/cast(tn+fp as double),6) as recommended_specificity from best""",
    )
)
def run_workflow(spark, sf):
    """QC, scores, explanations and calibration under one manifest row, whose calibration is shown in columns."""
    from ..operators.workflow import run_workflow as run
    from ..session import scratch_path

    labels = fx.metadata(spark, sf).select("sample", "label")
    done = run(spark, fx.binary_model(spark, sf), fx.expression(spark, sf), scratch_path(spark, "workflow"), labels, top_n=3)
    return rounded(done.withColumn("c", F.from_json("calibration_json", CALIBRATION)).select("*", "c.*").drop("run_id", "calibration_json", "c"))


@query(
    fx.with_views(
        fx.EXPRESSION, fx.METADATA, fx.BINARY_MODEL, fx.DEGRADED,
        "own as (select sample, count(*) filter (where value is null) as bad, count(*) as n from degraded group by sample)",
        body="""select 'stopped_after_invalid_input' as status, 0.5::double as threshold, count(*) as samples, (select count(distinct pos) from degraded)::int as input_genes,
 (select count(distinct d.pos) from degraded d join model m using (pos))::int as matched_model_genes, (select count(*) from model where pos not in (select pos from degraded))::int as missing_model_genes,
 'WARN' as qc_status, sum(bad)::bigint as invalid_matched_cells, null::bigint as tumor_calls, null::bigint as normal_calls, 'qc' as outputs, null::varchar as calibration_json,
 printf('share of invalid cells %.6f is above 0.000000; share of invalid cells in the worst sample %.6f is above 0.000000', sum(bad)/sum(n)::double, max(bad/n::double)) as error from own""",
    )
)
def run_workflow_invalid_input(spark, sf):
    """Invalid cells stop the run before any score is written."""
    from ..operators.workflow import run_workflow as run
    from ..session import scratch_path

    return run(spark, fx.binary_model(spark, sf), fx.degraded(spark, sf), scratch_path(spark, "workflow")).drop("run_id")
