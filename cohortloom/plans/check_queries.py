"""Data-quality checks, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import align as align_ops, checks, cohort, model as model_ops, score as score_ops, splits
from . import fixtures as fx
from .common import issues_sql, rounded, top5_sql
from .registry import query

RAW_KEYS = """keys as (select case when doc_id%50=0 then null when doc_id%50=1 then '  ' when doc_id%50=2 then ' d'||cast(doc_id as varchar)
  when doc_id%50=3 then 'd'||cast(doc_id//100 as varchar) else 'd'||cast(doc_id as varchar)||'x' end as sample from documents)"""


def spoiled_key():
    d, text = F.col("doc_id"), F.col("doc_id").cast("string")
    return (
        F.when(d % 50 == 0, F.lit(None))
        .when(d % 50 == 1, "  ")
        .when(d % 50 == 2, F.concat(F.lit(" d"), text))
        .when(d % 50 == 3, F.concat(F.lit("d"), F.expr("doc_id div 100").cast("string")))
        .otherwise(F.concat(F.lit("d"), text, F.lit("x")))
    )


def raw_keys(spark, sf):
    """Document ids spoiled in every way an identifier can be."""
    return fx.table(spark, sf, "documents").select(spoiled_key().alias("sample"))


KIND = "case when sample is null then 'missing' when trim(sample)='' then 'blank' when sample<>trim(sample) then 'padded' end"


@query(
    fx.with_views(
        RAW_KEYS,
        "bad as (select '['||sample||']' as k, " + KIND + " as kind from keys)",
        *[f"b_{k} as (select k from bad where kind='{k}')" for k in ("missing", "blank", "padded")],
        body=issues_sql(" union all ".join(top5_sql(f"b_{k}", "k", "sample", k) for k in ("missing", "blank", "padded"))),
    )
)
def sample_key(spark, sf):
    return checks.key_issues(raw_keys(spark, sf), "sample")


@query(
    fx.with_views(
        RAW_KEYS,
        "dup as (select sample from keys where sample is not null group by sample having count(*)>1)",
        body=issues_sql(top5_sql("dup", "sample", "sample", "duplicate")),
    )
)
def require_unique(spark, sf):
    return checks.duplicate_issues(raw_keys(spark, sf), "sample")


UNIQUE_KEY = [
    "g as (select sample as key, count(*) as copies from keys group by sample)",
    "bad as (select key, coalesce(case when key is null then 'missing' when trim(key)='' then 'blank' when key<>trim(key) then 'padded' end, case when copies>1 then 'duplicate' end) as kind from g)",
    *[f"b_{k} as (select key from bad where kind='{k}')" for k in ("missing", "blank", "padded", "duplicate")],
]


@query(
    fx.with_views(
        RAW_KEYS, *UNIQUE_KEY,
        body=issues_sql(" union all ".join(top5_sql(f"b_{k}", "key", "sample", k) for k in ("missing", "blank", "padded", "duplicate"))),
    )
)
def validate_identifier(spark, sf):
    return checks.unique_key_issues(raw_keys(spark, sf), "sample")


@query(
    (
        """select label, case when lower(trim(label)) in ('1','tumor','tumour','primary tumor','cancer','positive','pos','true') then 1
  when lower(trim(label)) in ('0','normal','solid tissue normal','healthy','negative','neg','false') then 0 end as label_binary, count(*) as n
  from (select case orderkey%9 when 0 then ' Tumor ' when 1 then 'NORMAL' when 2 then '1' when 3 then '0' when 4 then 'Primary Tumor'
   when 5 then 'Solid Tissue Normal' when 6 then 'healthy' when 7 then 'maybe' else 'pos' end as label from (select o_orderkey as orderkey from orders)) group by label"""
    )
)
def normalize_label(spark, sf):
    spellings = [" Tumor ", "NORMAL", "1", "0", "Primary Tumor", "Solid Tissue Normal", "healthy", "maybe", "pos"]
    label = F.get(F.array(*[F.lit(s) for s in spellings]), (F.col("o_orderkey") % 9).cast("int"))
    return (
        fx.table(spark, sf, "orders").select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
        .select("label", ids.normalize_label("label").alias("label_binary"), "n")
    )


@query(
    fx.with_views(
        fx.EXPRESSION,
        "rows_ as (select distinct sample from expression)",
        "genes as (select distinct pos, gene_id from expression)",
        *[f"s_{k} as (select sample from rows_ where false)" for k in ("missing", "blank", "padded", "duplicate")],
        body=issues_sql(
            " union all ".join(top5_sql(f"s_{k}", "sample", "sample", k) for k in ("missing", "blank", "padded", "duplicate"))
            + " union all "
            + " union all ".join(
                f"select 'gene_id' as check_name, '{k}' as code, {n} as n, '' as examples"
                for k, n in (
                    ("missing", "(select count(*) from genes where gene_id is null)"),
                    ("blank", "(select count(*) from genes where trim(gene_id)='')"),
                    ("padded", "(select count(*) from genes where gene_id<>trim(gene_id))"),
                    ("duplicate", "(select count(*)-count(distinct gene_id) from genes)"),
                )
            )
            + " union all select 'sample','empty',case when (select count(*) from rows_)=0 then 1 else 0 end,''"
            + " union all select 'gene_id','empty',case when (select count(*) from genes)=0 then 1 else 0 end,''"
        ),
    )
)
def validate_matrix(spark, sf):
    m = fx.expression(spark, sf)
    return checks.matrix_issues(m.rows, m.header())


@query(
    """select case when regexp_full_match(u,'[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then true else false end as uuid_ok,
  regexp_full_match(m,'[0-9a-f]{32}') as md5_ok, count(*) as n from (
 select lower(trim(case when o_orderkey%4=0 then h else h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32] end)) as u,
        lower(trim(case when o_orderkey%5=0 then substr(h,1,31) when o_orderkey%5=1 then upper(h) else h end)) as m
 from (select o_orderkey, md5(cast(o_orderkey as varchar)) as h from orders)) group by all"""
)
def valid_uuid_md5(spark, sf):
    h = F.md5(F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return (
        fx.table(spark, sf, "orders")
        .select(
            ids.valid_uuid(F.when(k % 4 == 0, h).otherwise(dashed)).alias("uuid_ok"),
            ids.valid_md5(F.when(k % 5 == 0, F.substring(h, 1, 31)).when(k % 5 == 1, F.upper(h)).otherwise(h)).alias("md5_ok"),
        )
        .groupBy("uuid_ok", "md5_ok")
        .agg(F.count("*").alias("n"))
    )


MANIFEST_RULES = [
    ("unclean_case_submitter_id", "case_submitter_id is null or trim(case_submitter_id)='' or case_submitter_id<>trim(case_submitter_id)"),
    ("unclean_project", "project is null or trim(project)='' or project<>trim(project)"),
    ("unclean_sample_type", "sample_type is null or trim(sample_type)='' or sample_type<>trim(sample_type)"),
    ("invalid_file_id", "not regexp_full_match(lower(trim(file_id)),'[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')"),
    ("other_project", "project<>'P-O'"),
    ("unsupported_sample_type", "sample_type not in ('Primary Tumor','Solid Tissue Normal')"),
    ("several_sample_types", "n_sample_types<>1"),
    ("several_cases", "contains(case_submitter_id,';')"),
    ("unclean_file_name", "file_name is null or trim(file_name)='' or file_name<>trim(file_name)"),
    ("invalid_file_size", "not (file_size>0)"),
    ("invalid_md5", "not regexp_full_match(lower(trim(md5sum)),'[0-9a-f]{32}')"),
]


def _key_rules(column: str) -> str:
    return (
        f"select '{column}' as check_name, 'missing' as code, (select count(*) from (select distinct {column} from manifest where {column} is null)) as n, '' as examples"
        f" union all select '{column}','blank',(select count(distinct {column}) from manifest where trim({column})=''),''"
        f" union all select '{column}','padded',0,'' union all "
        + top5_sql(f"(select {column} from manifest group by {column} having count(*)>1)", column, column, "duplicate")
    )


@query(
    fx.with_views(
        fx.MANIFEST,
        body=issues_sql(
            " union all ".join(f"select 'manifest' as check_name, '{c}' as code, (select count(*) from manifest where {w}) as n, '' as examples" for c, w in MANIFEST_RULES)
            + " union all " + _key_rules("file_id") + " union all " + _key_rules("sample_submitter_id")
            + " union all select 'manifest','single_class',case when (select count(distinct sample_type) from manifest)<2 then 1 else 0 end,''"
        ),
    )
)
def validate_cohort_manifest(spark, sf):
    return cohort.provider_manifest_issues(fx.file_manifest(spark, sf), "P-O")


@query(
    fx.with_views(
        fx.PHENOTYPE,
        body=issues_sql(
            """select 'manifest' as check_name, 'other_study' as code, (select count(*) from phenotype where study<>'GTEX') as n, '' as examples
 union all select 'manifest','blank_site',(select count(*) from phenotype where trim(primary_site)=''),''
 union all select 'manifest','unsupported_sample_type',(select count(*) from phenotype where sample_type<>'Normal Tissue'),''
 union all select 'manifest','foreign_prefix',(select count(*) from phenotype where not starts_with(sample,'GTEX-')),''
 union all select 'sample','missing',0,'' union all select 'sample','blank',0,'' union all select 'sample','padded',0,''
 union all select 'sample','duplicate',(select count(*) from (select sample from phenotype group by sample having count(*)>1)),''"""
        ),
    )
)
def validate_phenotype_manifest(spark, sf):
    return cohort.phenotype_manifest_issues(fx.phenotype(spark, sf), "GTEX")


@query(
    """select gene_base, looks_like_gene, count(*) as n from (
 select regexp_replace(g,'^(.+)\\.[0-9]+$','\\1') as gene_base, regexp_full_match(g,'ENSG[0-9]+(\\.[0-9]+)?') as looks_like_gene from (
 select case p_partkey%5 when 0 then 'ENSG'||cast(p_partkey%300 as varchar)||'.'||cast(p_size as varchar) when 1 then 'HLA.D'||cast(p_partkey%7 as varchar)||'A'
  when 2 then 'GENE.A.'||cast(p_partkey%3 as varchar) when 3 then '.'||cast(p_size as varchar) else 'ENSG'||cast(p_partkey%300 as varchar) end as g from part)) group by all"""
)
def strip_version(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    gene = (
        F.when(k % 5 == 0, F.concat(F.lit("ENSG"), (k % 300).cast("string"), F.lit("."), size))
        .when(k % 5 == 1, F.concat(F.lit("HLA.D"), (k % 7).cast("string"), F.lit("A")))
        .when(k % 5 == 2, F.concat(F.lit("GENE.A."), (k % 3).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("."), size))
        .otherwise(F.concat(F.lit("ENSG"), (k % 300).cast("string")))
    )
    return (
        fx.table(spark, sf, "part").select(gene.alias("g"))
        .groupBy(ids.strip_version("g").alias("gene_base"), ids.looks_like_gene("g").alias("looks_like_gene"))
        .agg(F.count("*").alias("n"))
    )


@query(
    """select donor_id, count(*) as n from (
 select case event_id%3 when 0 then 'GTEX-'||cast(user_id as varchar) when 1 then 'TCGA-'||cast(user_id%10 as varchar)||'-'||cast(user_id as varchar) else 'X-'||cast(user_id as varchar)||'-'||cast(event_id as varchar) end as donor_id from events) group by donor_id"""
)
def donor_id(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    barcode = (
        F.when(F.col("event_id") % 3 == 0, F.concat_ws("-", F.lit("GTEX"), u, e))
        .when(F.col("event_id") % 3 == 1, F.concat_ws("-", F.lit("TCGA"), (F.col("user_id") % 10).cast("string"), u, e))
        .otherwise(F.concat_ws("-", F.lit("X"), u, e))
    )
    return fx.table(spark, sf, "events").select(ids.donor_id(barcode).alias("donor_id")).groupBy("donor_id").agg(F.count("*").alias("n"))


@query(
    """select project, case when regexp_full_match(project,'TCGA-.+') then substr(project,6) end as type_code, count(*) as n from (
 select case when o_orderkey%4=0 then 'TCGA-' when o_orderkey%4=1 then 'OTHER-'||o_orderstatus else 'TCGA-'||o_orderstatus end as project from orders) group by all"""
)
def project_code(spark, sf):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 0, "TCGA-").when(k == 1, F.concat(F.lit("OTHER-"), F.col("o_orderstatus"))).otherwise(F.concat(F.lit("TCGA-"), F.col("o_orderstatus")))
    return (
        fx.table(spark, sf, "orders").select(p.alias("project")).groupBy("project").agg(F.count("*").alias("n"))
        .select("project", ids.project_code("project").alias("type_code"), "n")
    )


@query(
    fx.with_views(
        fx.METADATA,
        "a as (select case_id from metadata group by case_id having min(submitter_id)<>max(submitter_id))",
        "b as (select submitter_id from metadata group by submitter_id having min(case_id)<>max(case_id))",
        body=issues_sql(top5_sql("a", "case_id", "case_id->submitter_id", "not_unique") + " union all " + top5_sql("b", "submitter_id", "submitter_id->case_id", "not_unique")),
    )
)
def check_bijection(spark, sf):
    return splits.bijection_issues(fx.metadata(spark, sf), "case_id", "submitter_id")


@query(
    fx.with_views(
        "a as (select o_custkey from orders group by o_custkey having min(o_orderstatus)<>max(o_orderstatus))",
        body=issues_sql(top5_sql("a", "o_custkey", "o_custkey->o_orderstatus", "not_unique")),
    )
)
def check_functional_dependency(spark, sf):
    """Customers as cases, order status as project: most break the rule."""
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus")
    return splits.dependency_issues(o, "o_custkey", "o_orderstatus")


SPLIT_SQL = fx.with_views(
    fx.METADATA,
    "tr as (select sample from metadata where not is_test union all select sample from metadata where sample like '%7')",
    "te as (select sample from metadata where is_test)",
    "trk as (select sample, count(*) as k from tr group by sample)",
    "tek as (select sample, count(*) as k from te group by sample)",
    body=issues_sql(
        """select 'train' as check_name, 'duplicate' as code, (select count(*) from trk where k>1) as n, '' as examples
 union all select 'test','duplicate',(select count(*) from tek where k>1),''
 union all select 'split','overlap',(select count(*) from trk join tek using (sample)),''
 union all select 'split','out_of_range',0,''
 union all select 'split','uncovered',(select count(*) from metadata m where m.sample not in (select sample from tr) and m.sample not in (select sample from te)),''
 union all select 'train','single_class',case when (select count(distinct y) from metadata where sample in (select sample from tr))<2 then 1 else 0 end,''
 union all select 'test','single_class',case when (select count(distinct y) from metadata where sample in (select sample from te))<2 then 1 else 0 end,''"""
    ),
)


@query(SPLIT_SQL)
def check_split(spark, sf):
    """A split in which some samples were added to train a second time."""
    m = fx.metadata(spark, sf).select("sample", F.col("y").alias("label"), "is_test")
    train = m.where("not is_test").select("sample").unionByName(m.where(F.col("sample").endswith("7")).select("sample"))
    return splits.split_issues(m, train, m.where("is_test"))


@query(
    fx.with_views(
        fx.METADATA,
        "tr as (select * from metadata where y=0)",
        "te as (select * from metadata where y=1)",
        "a as (select distinct case_id from te where case_id in (select case_id from tr))",
        "b as (select distinct submitter_id from te where submitter_id in (select submitter_id from tr))",
        body=issues_sql(top5_sql("a", "case_id", "case_id", "leakage") + " union all " + top5_sql("b", "submitter_id", "submitter_id", "leakage")),
    )
)
def check_leakage(spark, sf):
    """Tumors against normals as if they were a split: patients leak."""
    m = fx.metadata(spark, sf)
    return splits.leakage_issues(m.where("y = 0"), m.where("y = 1"), ["case_id", "submitter_id"])


@query(
    issues_sql(
        """select 'value' as check_name, 'non_numeric_probability' as code, (select count(*) from events where value is null or not isfinite(value)) as n, '' as examples
 union all select 'value','probability_out_of_range',(select count(*) from events where value<0 or value>1),''"""
    )
)
def check_probability(spark, sf):
    return checks.probability_issues(fx.table(spark, sf, "events"), "value")


@query(
    fx.with_views(
        fx.NORMALS,
        body=issues_sql(
            """select 'scores' as check_name, 'column_contract_mismatch' as code, 0 as n, '' as examples
 union all select 'sample','missing',0,'' union all select 'sample','blank',0,'' union all select 'sample','padded',0,''
 union all select 'sample','duplicate',(select count(*) from (select sample from normals group by sample having count(*)>1)),''
 union all select 'scores','non_numeric_probability',(select count(*) from normals where tumor_probability is null),''
 union all select 'scores','probability_out_of_range',(select count(*) from normals where tumor_probability<0 or tumor_probability>1),''
 union all select 'scores','invalid_call_value',0,''"""
        ),
    )
)
def check_output_contract_scores(spark, sf):
    return checks.contract_issues(fx.normal_scores(spark, sf).select("sample", "tumor_probability", "call"), "scores")


THRESHOLD_ROWS = """spoiled as (select case when o_orderkey%5=0 then 'default' else 'extra' end as threshold_name,
  case when o_orderkey%11=0 then 'high' when o_orderkey%13=0 then null else cast(o_orderkey%17/10.0 as varchar) end as metric,
  case when o_orderkey%7=0 then '1d' else cast(o_orderkey%19-3 as varchar) end as amount from orders),
m as (select metric, try_cast(metric as double) as v from spoiled), a as (select amount, case when amount<>'1d' then cast(amount as double) end as v from spoiled)"""


@query(
    fx.with_views(
        THRESHOLD_ROWS,
        body=issues_sql(
            """select 'thresholds' as check_name, 'column_contract_mismatch' as code, 0 as n, '' as examples
 union all select 'thresholds','threshold_rows_missing',(select 2-count(distinct threshold_name) from spoiled where threshold_name in ('default','youden_j')),''
 union all select 'thresholds.'||c, 'non_numeric_metric', (select count(*) from m where metric is not null and v is null), '' from (select unnest(['threshold','accuracy','f1','precision','recall','specificity','youden_j']) as c)
 union all select 'thresholds.'||c, 'metric_out_of_range', (select count(*) from m where v<0 or v>1), '' from (select unnest(['threshold','accuracy','f1','precision','recall','specificity','youden_j']) as c)
 union all select 'thresholds.'||c, 'non_numeric_count', (select count(*) from a where v is null), '' from (select unnest(['tn','fp','fn','tp']) as c)
 union all select 'thresholds.'||c, 'negative_count', (select count(*) from a where v<0), '' from (select unnest(['tn','fp','fn','tp']) as c)"""
        ),
    )
)
def check_output_contract_thresholds(spark, sf):
    """A thresholds table made from orders, with words, gaps and odd numbers among its cells."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "default").otherwise("extra").alias("threshold_name")
    metric = F.when(k % 11 == 0, "high").when(k % 13 != 0, (k % 17 / 10.0).cast("string"))
    amount = F.when(k % 7 == 0, "1d").otherwise((k % 19 - 3).cast("string"))
    cells = [name if c == "threshold_name" else (amount if c in ("tn", "fp", "fn", "tp") else metric).alias(c) for c in checks.CONTRACTS["thresholds"]]
    return checks.contract_issues(fx.table(spark, sf, "orders").select(*cells), "thresholds")


@query(
    issues_sql(
        """select 'gene_metadata' as check_name, 'column_contract_mismatch' as code, 0 as n, '' as examples
 union all select 'gene_id','duplicate',0,'' union all select 'gene_metadata','invalid_model_gene_direction',0,'' union all select 'gene_metadata','invalid_scaler_scale',0,''"""
    )
)
def check_output_contract_gene_metadata(spark, sf):
    from ..operators.explain import gene_metadata

    t = fx.binary_tables(spark, sf)
    names = fx.gene_table(spark).select(F.col("gene_id").alias("key"), F.lit("n").alias("gene_name"))
    return checks.contract_issues(gene_metadata(t.genes, t.coef, names), "gene_metadata")


@query(
    issues_sql(
        """select 'explanations' as check_name, 'column_contract_mismatch' as code, 0 as n, '' as examples
 union all select 'explanations', c, 0, '' from (select unnest(['non_numeric_probability','probability_out_of_range','invalid_explanation_direction','invalid_explanation_rank']) as c)"""
    )
)
def check_output_contract_explanations(spark, sf):
    from ..operators.explain import explain

    return checks.contract_issues(explain(fx.binary_model(spark, sf), fx.expression(spark, sf), 3), "explanations")


@query(
    fx.with_views(
        fx.NORMALS,
        body="""select count(*) as n, 0 as n_only_left, 0 as n_only_right, round(max(abs(tumor_probability-round(tumor_probability,2))),6) as max_abs_delta,
 count(*) filter (where (tumor_probability>=0.5)<>(round(tumor_probability,2)>=0.5)) as n_call_changes, false as consistent from normals""",
    )
)
def check_score_consistency(spark, sf):
    """Scores against the same scores shown at two digits."""
    full = fx.normal_scores(spark, sf)
    p = F.round("tumor_probability", 2)
    short = full.select("sample", p.alias("tumor_probability"), F.when(p >= 0.5, "tumor").otherwise("normal").alias("call"))
    return rounded(checks.score_consistency(full, short))


@query(
    fx.with_views(
        "heads as (select distinct label%2 as class_idx, case when label%2=1 then 'Normal' else 'Healthy' end as class from embeddings)",
        "bad as (select class from heads where class_idx=1)",
        body=issues_sql(top5_sql("bad", "class", "head", "class_order")),
    )
)
def validate_tumor_model(spark, sf):
    """Class names from the label column, with class 1 misnamed."""
    head = fx.table(spark, sf, "embeddings").select(
        (F.col("label") % 2).alias("class_idx"), F.when(F.col("label") % 2 == 1, "Normal").otherwise("Healthy").alias("class"), F.lit(0.0).alias("intercept")
    ).distinct()
    t = fx.binary_tables(spark, sf)
    return model_ops.tumor_model_issues(model_ops.ModelTables(t.genes, t.coef, head, "binary"))


GENE_META = """meta as (select 'ENSG'||cast(p_partkey%400 as varchar)||'.'||cast(p_partkey%2+1 as varchar) as gene_id,
  'ENSG'||cast(p_partkey%400 as varchar) as gene_id_base, 'G'||cast(p_partkey%800 as varchar) as gene_name from part)"""


def gene_meta(spark, sf):
    k = F.col("p_partkey")
    base = F.concat(F.lit("ENSG"), (k % 400).cast("string"))
    return fx.table(spark, sf, "part").select(
        F.concat(base, F.lit("."), (k % 2 + 1).cast("string")).alias("gene_id"), base.alias("gene_id_base"), F.concat(F.lit("G"), (k % 800).cast("string")).alias("gene_name")
    )


@query(
    fx.with_views(
        GENE_META,
        "keys as (select gene_id as key, gene_name from meta union all select gene_id_base, gene_name from meta)",
        "bad as (select key from keys group by key having min(gene_name)<>max(gene_name))",
        body=issues_sql("select 'gene_metadata' as check_name,'unclean_id' as code,0 as n,'' as examples union all " + top5_sql("bad", "key", "gene_metadata", "conflicting_name")),
    )
)
def validate_gene_metadata(spark, sf):
    return checks.gene_metadata_issues(gene_meta(spark, sf))


DEGRADED_TOTALS = """per_sample as (select sample, count(*) filter (where value is null) as bad from degraded group by sample),
per_gene as (select pos, gene_id, count(*) filter (where value is null) as bad, count(*) as total from degraded group by pos, gene_id),
totals as (select count(*) as n_samples, sum(bad) as invalid, count(*) filter (where bad>0) as bad_samples, max(bad) as worst,
  (select count(*) from per_gene) as k, (select count(*) from per_gene where bad=total) as all_bad_genes, count(*) filter (where bad=(select count(*) from per_gene)) as all_bad_samples from per_sample)"""


@query(
    fx.with_views(
        fx.EXPRESSION, fx.DEGRADED, DEGRADED_TOTALS,
        body="""select code, message from (
 select 'invalid_fraction' as code, printf('share of invalid cells %.6f is above 0.010000', invalid/(n_samples*k)) as message, invalid/(n_samples*k) > 0.01 as bad from totals
 union all select 'worst_sample_fraction', printf('share of invalid cells in the worst sample %.6f is above 0.010000', worst/k), worst/k>0.01 from totals
 union all select 'all_invalid_genes', '', all_bad_genes>0 from totals union all select 'all_invalid_samples', '', all_bad_samples>0 from totals) where bad""",
    )
)
def validate_alignment(spark, sf):
    a = align_ops.align(fx.degraded(spark, sf), fx.binary_model(spark, sf))
    return align_ops.alignment_issues(align_ops.alignment_report(a), 0.01)


@query(
    fx.with_views(
        fx.EXPRESSION, fx.DEGRADED,
        body="""select 'low_model_gene_coverage' as code, printf('%d of %d model genes are in the header; wanted a share of 0.950', m, 64) as message
 from (select count(distinct pos) as m from degraded) where m/64.0<0.95""",
    )
)
def validate_gene_match(spark, sf):
    a = align_ops.align(fx.degraded(spark, sf), fx.binary_model(spark, sf))
    return align_ops.gene_match_issues(align_ops.alignment_report(a), 0.95)


@query(
    issues_sql(
        """select 'metric_inputs' as check_name,'empty' as code,0 as n,'' as examples
 union all select 'metric_inputs','non_binary_label',(select count(*) from lineitem where l_linenumber not in (0,1)),''
 union all select 'metric_inputs','non_finite_score',(select count(*) from lineitem where l_orderkey%3<>0),''
 union all select 'metric_inputs','single_class',case when (select count(distinct l_linenumber) from lineitem where l_linenumber in (0,1))<2 then 1 else 0 end,''"""
    )
)
def check_metric_inputs(spark, sf):
    """Line numbers as labels; scores of two orders in three are NaN or null."""
    k = F.col("l_orderkey") % 3
    score = F.when(k == 1, F.lit(float("nan"))).when(k == 0, F.col("l_discount"))
    return checks.metric_input_issues(fx.table(spark, sf, "lineitem").withColumn("score", score), "l_linenumber", "score", both_classes=True)


@query(
    fx.with_views(
        RAW_KEYS.replace("from documents", ", n_chars/1000.0 as tumor_probability from documents"), *UNIQUE_KEY,
        body=issues_sql(
            " union all ".join(top5_sql(f"b_{k}", "key", "sample", k) for k in ("missing", "blank", "padded", "duplicate"))
            + " union all select 'tumor_probability','non_numeric_probability',0,''"
            + " union all select 'tumor_probability','probability_out_of_range',(select count(*) from keys where tumor_probability>1 or tumor_probability<0),''"
        ),
    )
)
def check_scored(spark, sf):
    scored = fx.table(spark, sf, "documents").select(spoiled_key().alias("sample"), (F.col("n_chars") / 1000.0).alias("tumor_probability"))
    return checks.scored_issues(scored)


@query(
    fx.with_views(
        fx.EXPRESSION, fx.DEGRADED,
        body="""select 'low_model_gene_coverage' as code from (select count(distinct pos) as m from degraded) where m/64.0<0.9
 union all select 'invalid_fraction' from (select count(*) filter (where value is null)/count(*) as f from degraded) where f>0
 union all select 'worst_sample_fraction' from (select max(b) as f from (select count(*) filter (where value is null) as b from degraded group by sample)) where f>0""",
    )
)
def guard_issues(spark, sf):
    a = align_ops.align(fx.degraded(spark, sf), fx.binary_model(spark, sf))
    return score_ops.guard_issues(a, 0.0, 0.9).select("code")


@query(
    fx.with_views(
        fx.COUNTS,
        "wanted as (select 'ENSG'||lpad(cast(p_partkey%600 as varchar),11,'0') as gene_id from part)",
        body="""select distinct gene_id from wanted where gene_id not in (select regexp_replace(gene_id,'\\.[0-9]+$','') from counts)""",
    )
)
def set_difference(spark, sf):
    """Model genes (from parts) that no count file has."""
    wanted = fx.table(spark, sf, "part").select(F.concat(F.lit("ENSG"), F.lpad((F.col("p_partkey") % 600).cast("string"), 11, "0")).alias("gene_id"))
    have = fx.counts(spark, sf).select(ids.strip_version("gene_id").alias("gene_id"))
    return checks.missing_names(wanted, have, "gene_id")

