"""Sources and sinks: the given tables are written out in each provider format
below the session's scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import strip_version
from ..operators import model as model_ops
from ..operators.align import select_genes
from ..session import scratch_path
from ..sources import counts as count_files, features, manifest, matrix, tables
from . import fixtures as fx
from .common import issues_sql, rounded, top5_sql
from .registry import query

LONG = "select sample, gene_id, round(value,6) as value from expression"


def long_cells(m: matrix.ExpressionMatrix) -> DataFrame:
    return rounded(m.long().select("sample", "gene_id", "value"))


def _round_trip(spark: SparkSession, sf: str, fmt: str, **options) -> DataFrame:
    path = matrix.write_matrix(fx.expression(spark, sf), scratch_path(spark, f"matrix-{fmt}"), fmt)
    return long_cells(matrix.read_matrix(spark, path, fmt, **options))


@query(fx.with_views(fx.EXPRESSION, body=LONG))
def read_matrix_csv(spark, sf):
    return _round_trip(spark, sf, "csv")


@query(fx.with_views(fx.EXPRESSION, body=LONG))
def read_matrix_tsv(spark, sf):
    return _round_trip(spark, sf, "tsv")


@query(fx.with_views(fx.EXPRESSION, body=LONG))
def read_matrix_parquet(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query(fx.with_views(fx.EXPRESSION, body=LONG + " where pos % 3 = 0"))
def read_matrix_parquet_model_genes(spark, sf):
    path = matrix.write_matrix(fx.expression(spark, sf), scratch_path(spark, "matrix-pruned"), "parquet")
    wanted = [g.rsplit(".", 1)[0] for i, g in enumerate(fx.GENES) if i % 3 == 0]
    return long_cells(matrix.read_parquet_genes(spark, path, wanted))


@query(fx.with_views(fx.EXPRESSION, body=LONG))
def read_matrix_transposed(spark, sf):
    path = matrix.write_gene_rows(fx.expression(spark, sf), scratch_path(spark, "gene-rows"), block=200)
    return long_cells(matrix.read_matrix(spark, path, "tsv", transpose=True))


@query(fx.with_views(fx.EXPRESSION, body=LONG))
def read_expression_named_index(spark, sf):
    """Sample column in third place, found by name."""
    m = fx.expression(spark, sf)
    moved = m.rows.select(
        F.get("cells", F.lit(0)).cast("string").alias("sample"),
        F.concat(F.array(F.get("cells", F.lit(1)).cast("string"), F.col("sample")), F.transform(F.slice("cells", 3, fx.N_GENES), lambda c: c.cast("string"))).alias("cells"),
    )
    header = (fx.GENES[1], "sample_name", *fx.GENES[2:])
    path = matrix.write_matrix(matrix.ExpressionMatrix(moved, header), scratch_path(spark, "matrix-index"), "csv", id_name=fx.GENES[0])
    return long_cells(matrix.read_matrix(spark, path, "csv", index_col="sample_name"))


@query(
    fx.with_views(
        "header as (select row_number() over (order by p_partkey)-1 as pos, 'ENSG'||cast(p_partkey%700 as varchar) as gene_id from part)",
        "dup as (select gene_id from header group by gene_id having count(*)>1)",
        "blank as (select pos from header where trim(gene_id)='')",
        "lead_gene as (select gene_id from header where pos=0 and regexp_full_match(gene_id,'ENSG[0-9]+(\\.[0-9]+)?'))",
        body=issues_sql(
            top5_sql("blank", "pos", "header", "blank_gene")
            + " union all "
            + top5_sql("dup", "gene_id", "header", "duplicate_gene")
            + " union all "
            + top5_sql("lead_gene", "gene_id", "header", "gene_like_id_column")
        ),
    )
)
def check_header(spark, sf):
    """A header made of part keys; many genes occur twice."""
    header = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("ENSG"), (F.col("p_partkey") % 700).cast("string")).alias("gene_id")
    )
    return matrix.header_problems(header)


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_nationkey, round(c_acctbal,6) as c_acctbal, c_mktsegment from customer")
def read_table(spark, sf):
    path = tables.write_table(fx.table(spark, sf, "customer"), scratch_path(spark, "customer-csv"))
    return rounded(tables.read_table(spark, path, ["c_custkey"]))


MODEL_CHECK_SQL = fx.with_views(
    fx.EXPRESSION,
    fx.METADATA,
    fx.BINARY_MODEL,
    body="""select count(*) as n_genes, count(distinct gene_id) as n_ids, count(distinct regexp_replace(gene_id,'\\.[0-9]+$','')) as n_bases,
  sum(case when isfinite(mean) and isfinite(scale) and isfinite(coef) then 0 else 1 end) as n_non_finite,
  sum(case when scale<=0 then 1 else 0 end) as n_bad_scale, round(sum(mean),6) as mean_sum, round(sum(scale),6) as scale_sum, round(sum(coef),6) as coef_sum, 0 as n_issues
from model""",
)


@query(MODEL_CHECK_SQL)
def validate_model(spark, sf):
    """Write the analytic model as tables, read it back, run all its rules."""
    t = model_ops.read_model(spark, model_ops.write_model(fx.binary_tables(spark, sf), scratch_path(spark, "model")), "binary")
    issues = model_ops.model_issues(t).agg(F.sum("n").alias("n_issues"))
    facts = t.genes.join(t.coef, "pos").agg(
        F.count("*").alias("n_genes"),
        F.count_distinct("gene_id").alias("n_ids"),
        F.count_distinct(strip_version("gene_id")).alias("n_bases"),
        F.count_if(F.isnan("mean") | F.isnan("scale") | F.isnan("coef")).alias("n_non_finite"),
        F.count_if(F.col("scale") <= 0).alias("n_bad_scale"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("mean", "scale", "coef")],
    )
    merged = facts.unionByName(issues, allowMissingColumns=True)
    return rounded(merged.agg(*[F.max(c).alias(c) for c in merged.columns]))


COUNT_GENES = tuple(f"ENSG{g:011d}" for g in range(0, 500, 2))


@query(
    fx.with_views(
        fx.COUNTS,
        body="""select 'supp'||cast(l_suppkey as varchar) as file_id, 'ENSG'||lpad(cast(l_partkey%500 as varchar),11,'0') as gene_id,
  round(log2(max(l_quantity)+1),6) as value from lineitem where (l_partkey%500)%2=0 group by l_suppkey, l_partkey%500""",
    )
)
def read_count_files(spark, sf):
    """One STAR-style file per supplier with comment, header and N_ rows; every other one has its columns reversed."""
    turned = F.col("l_suppkey") % 2 == 1

    def line(*fields):
        return F.when(turned, F.concat_ws("\t", *fields[::-1])).otherwise(F.concat_ws("\t", *fields))

    li = fx.table(spark, sf, "lineitem")
    body = (
        li.groupBy("l_suppkey", (F.col("l_partkey") % 500).alias("g"))
        .agg(F.max("l_quantity").alias("tpm"))
        .select(
            "l_suppkey",
            (F.col("g") + 10).alias("at"),
            line(F.concat(F.lit("ENSG"), F.lpad(F.col("g").cast("string"), 11, "0"), F.lit("."), (F.col("g") % 3 + 1).cast("string")), F.lit("sym"), F.lit("protein_coding"), F.col("tpm").cast("string")).alias("value"),
        )
    )
    # Five fixed lines per file.
    names = line(*map(F.lit, ("gene_id", "gene_name", "gene_type", "tpm_unstranded")))
    fixed = [F.lit("# gene-model: test"), names, F.lit(""), line(F.lit("N_unmapped"), *[F.lit("")] * 3), line(F.lit("N_multimapping"), *[F.lit("")] * 3)]
    # 500 genes at most.
    own = body.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("lines"))
    texts = own.select(F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("file"), F.array_join(F.concat(F.array(*fixed), "lines"), "\n").alias("value"))
    path = scratch_path(spark, "star-counts")
    fx.write_files(texts, path)
    cells = count_files.read_count_files(spark, path, COUNT_GENES, file_id=fx.FILE_ID)
    return rounded(cells)


@query(
    fx.with_views(
        fx.COUNTS,
        body="""select 'ord'||cast(l_orderkey as varchar) as sample, 'ENSG'||lpad(cast(l_partkey%500 as varchar),11,'0') as gene_id, round(log2(max(l_quantity)+1),6) as value
  from lineitem where (l_partkey%500)<40 group by l_orderkey, l_partkey%500""",
    )
)
def files_to_matrix(spark, sf):
    """Long count cells to dense rows in model order; absent cells stay null."""
    cells = fx.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("ord"), F.col("l_orderkey").cast("string")).alias("file_id"),
        F.concat(F.lit("ENSG"), F.lpad((F.col("l_partkey") % 500).cast("string"), 11, "0")).alias("gene_id"),
    ).agg(F.log2(F.max("l_quantity") + 1.0).alias("value"))
    m = count_files.files_to_matrix(cells, [f"ENSG{g:011d}" for g in range(40)])
    return long_cells(m).where("value is not null")


@query(
    fx.with_views(
        fx.EXPRESSION,
        body="""select sample, gene_id, round(log2(greatest(pow(2,round(value-8,6))-0.001,0)+1),6) as value from expression
  where pos%2=0 and vec_id%3=0""",
    )
)
def read_gene_by_sample_matrix(spark, sf):
    """gzip gene-by-sample files in log2(tpm+0.001), selected samples and genes."""
    m = fx.expression(spark, sf)
    shifted = matrix.ExpressionMatrix(m.rows.select("sample", F.transform("cells", lambda v: F.round(v - 8.0, 6)).alias("cells")), m.genes)
    path = matrix.write_gene_rows(shifted, scratch_path(spark, "gene-rows-gz"), block=200, compression="gzip")
    wanted = [g for i, g in enumerate(fx.GENES) if i % 2 == 0]
    samples = fx.table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(fx.sample_id().alias("sample"))
    return rounded(count_files.read_gene_by_sample(spark, path, wanted, samples))


@query(
    """with hits as (
  select 'f'||cast(o_orderkey as varchar) as file_id, o_custkey, o_orderkey, o_orderstatus from orders),
rows_ as (
  select file_id, 'P-'||o_orderstatus as project,
    case when o_orderkey%5=0 then case when 'c'||cast(o_custkey as varchar) <= 'c'||cast(o_custkey+1 as varchar)
           then 'c'||cast(o_custkey as varchar)||';c'||cast(o_custkey+1 as varchar) else 'c'||cast(o_custkey+1 as varchar)||';c'||cast(o_custkey as varchar) end
         else 'c'||cast(o_custkey as varchar) end as case_submitter_id,
    's'||cast(o_orderkey as varchar)||'a;s'||cast(o_orderkey as varchar)||'b' as sample_submitter_id,
    case when o_orderkey%7=0 then 2 else 1 end as n_sample_types,
    case when o_orderkey%3=0 then 'Solid Tissue Normal' when o_orderkey%3=1 then 'Primary Tumor' else 'Metastatic' end as t, o_orderkey
  from hits)
select file_id, project, case_submitter_id, sample_submitter_id, t as sample_type, n_sample_types from rows_
where n_sample_types=1 and t<>'Metastatic'"""
)
def flatten_manifest(spark, sf):
    """Orders as nested provider hits with one or two cases of two samples."""
    o = fx.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Solid Tissue Normal").when(F.col("o_orderkey") % 3 == 1, "Primary Tumor").otherwise("Metastatic")
    other = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Cell Line")).otherwise(kind)

    def case(custkey, suffix, t):
        return F.struct(
            F.concat(F.lit("c"), custkey.cast("string")).alias("submitter_id"),
            F.struct(F.concat(F.lit("P-"), F.col("o_orderstatus")).alias("project_id")).alias("project"),
            F.array(F.struct(F.concat(F.lit("s"), F.col("o_orderkey").cast("string"), F.lit(suffix)).alias("submitter_id"), t.alias("sample_type"))).alias("samples"),
        )

    two = F.array(case(F.col("o_custkey"), "a", kind), case(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "b", other))
    hits = o.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"), F.lit("n").alias("file_name"), F.lit(1).cast("bigint").alias("file_size"),
        F.lit("m").alias("md5sum"), two.alias("cases"),
    )
    path = scratch_path(spark, "manifest-json")
    # Every file is listed twice, as a provider page overlap would do.
    hits.unionByName(hits).write.json(path)
    return manifest.flatten_manifest(manifest.read_manifest(spark, path)).drop("file_name", "file_size", "md5sum")


@query(fx.with_views(fx.PHENOTYPE, body="select sample, study, sample_type, primary_site from phenotype"))
def read_phenotype(spark, sf):
    path = scratch_path(spark, "phenotype")
    fx.phenotype(spark, sf).toDF("sample", "_study", "_sample_type", "_primary_site").write.option("encoding", "ISO-8859-1").csv(path, header=True, sep="\t")
    return tables.read_phenotype(spark, path)


@query(fx.with_views(fx.SCORES, body="select sample, round(tumor_probability,6) as tumor_probability, case when tumor_probability>=0.5 then 'tumor' else 'normal' end as call from scores"))
def write_scores(spark, sf):
    from ..functions.numeric import call

    scored = fx.scores(spark, sf).withColumn("call", call("tumor_probability", 0.5))
    path = tables.write_table(scored, scratch_path(spark, "scores"))
    return rounded(tables.read_table(spark, path, ["sample"]))


@query(
    fx.with_views(
        fx.SCORES,
        body="""select lang, '{"lang":"'||lang||'","n":'||cast(count(*) as varchar)||',"undefined":null,"share":'
  ||case when count(*)>0 then 'true' else 'false' end||'}' as report_json from scores group by lang""",
    )
)
def write_report_json(spark, sf):
    """One JSON report per language; a non-finite number becomes null."""
    r = fx.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", "n", (F.lit(0.0) / F.lit(float("nan"))).alias("undefined"), (F.col("n") > 0).alias("share")
    )
    path = tables.write_report_json(r, scratch_path(spark, "reports"))
    return spark.read.text(path).select(F.get_json_object("value", "$.lang").alias("lang"), F.col("value").alias("report_json"))


EXPORT_SQL = fx.with_views(
    fx.EXPRESSION,
    body="""select sample, count(*) as n_genes, round(sum(value),6) as sum64, round(sum(cast(cast(value as float) as double)),6) as sum32 from expression group by sample""",
)


@query(EXPORT_SQL)
def export_features(spark, sf):
    path = scratch_path(spark, "features")
    features.export_features(fx.expression(spark, sf), path)
    x64, genes = features.read_features(spark, path, "float64")
    x32, _ = features.read_features(spark, path, "float32")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(
        x64.select("sample", F.size("x").alias("n_genes"), total("x").alias("sum64")).join(
            x32.select("sample", total(F.col("x").cast("array<double>")).alias("sum32")), "sample"
        )
    )


@query(
    fx.with_views(
        fx.EXPRESSION,
        body=issues_sql(
            """select 'features' as check_name, 'shape_mismatch' as code, case when count(distinct n)=1 and max(n)=64 then 0 else 1 end as n, '' as examples
 from (select sample, count(*) as n from expression group by sample) union all select 'features','element_type',0,'' union all select 'features','mixed_generations',0,''"""
        ),
    )
)
def check_feature_generation(spark, sf):
    m = fx.expression(spark, sf)
    x = features.feature_rows(m, "float64", "g1")
    return features.feature_issues(x, m.header().withColumn("generation", F.lit("g1")))


@query(
    fx.with_views(
        fx.COUNTS,
        body="""select file_id, 'ENSG'||lpad(cast(cast(substr(gene_id,5,11) as integer) as varchar),11,'0') as target, count(*) as n_rows, round(sum(tpm),6) as tpm
from counts where cast(substr(gene_id,5,11) as integer)%2=0 group by all""",
    )
)
def select_genes_semi(spark, sf):
    """Cells of wanted genes by exact or version-free id."""
    wanted = count_files.genes_frame(spark, COUNT_GENES)
    return rounded(
        select_genes(fx.counts(spark, sf), wanted).groupBy("file_id", "target").agg(F.count("*").alias("n_rows"), F.sum("tpm").alias("tpm"))
    )

