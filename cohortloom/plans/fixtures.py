"""Views over the given tables, in Spark and as DuckDB text.

``embeddings`` gives an expression matrix (64 genes) with projects, labels and
patients; ``documents``/``labels`` scores with many ties; ``events`` a
phenotype; ``lineitem`` count files; ``orders``/``customer`` a file manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import donor_id
from ..functions.numeric import gather, int_array
from ..operators.adapt import unit_if_zero
from ..operators.model import LinearModel, ModelTables, collect_model
from ..sources.matrix import ExpressionMatrix, write_gene_rows

N_GENES = 64
GENES = tuple(f"ENSG{p:011d}.{p % 9 + 1}" for p in range(N_GENES))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- expression ------------------------------------------------------------


def sample_id(c: str = "vec_id"):
    return F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 6, "0"))


def metadata_columns() -> dict:
    slot = F.expr("(vec_id * 10 + label) div 20")
    kind = F.expr("label div 2").cast("string")
    return {
        "project": F.concat(F.lit("TCGA-T"), kind),
        "label": F.when(F.col("label") % 2 == 1, "tumor").otherwise("normal"),
        "y": (F.col("label") % 2).cast("int"),
        "case_id": F.concat(F.lit("case"), slot.cast("string"), F.lit("_"), kind),
        "submitter_id": F.concat(F.lit("sub"), slot.cast("string"), F.lit("_"), kind),
        "is_test": slot % 5 == 0,
    }


def cell_values():
    return F.transform("embedding", lambda v: F.round(6.0 + 8.0 * v.cast("double"), 6))


def expression(spark: SparkSession, sf: str) -> ExpressionMatrix:
    return ExpressionMatrix(table(spark, sf, "embeddings").select(sample_id().alias("sample"), cell_values().alias("cells")), GENES)


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(sample_id().alias("sample"), *[c.alias(n) for n, c in metadata_columns().items()])


def labelled_expression(spark: SparkSession, sf: str) -> ExpressionMatrix:
    """Expression rows that carry their metadata along."""
    return ExpressionMatrix(
        table(spark, sf, "embeddings").select(
            sample_id().alias("sample"), *[c.alias(n) for n, c in metadata_columns().items()], cell_values().alias("cells")
        ),
        GENES,
    )


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_expression(spark, sf).rows.withColumnRenamed("cells", "x")


DEGRADED_POSITIONS = tuple(p for p in range(N_GENES) if p % 7 != 3)
DEGRADED_GENES = tuple(GENES[p] if p % 2 else GENES[p].rsplit(".", 1)[0] for p in DEGRADED_POSITIONS)


def degraded(spark: SparkSession, sf: str, shift: float = 0.0) -> ExpressionMatrix:
    """Every seventh gene missing, some cells unreadable, half the ids unversioned."""
    cells = F.zip_with(
        gather("value", DEGRADED_POSITIONS),
        int_array(DEGRADED_POSITIONS),
        lambda v, p: F.when((p * 31 + F.col("vec_id")) % 97 == 0, F.lit("bad")).otherwise((v + shift).cast("string")),
    )
    rows = table(spark, sf, "embeddings").select("vec_id", sample_id().alias("sample"), cell_values().alias("value"))
    return ExpressionMatrix(rows.select("sample", cells.alias("cells")), DEGRADED_GENES)


# --- models ----------------------------------------------------------------


def training_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_expression(spark, sf).rows.where("not is_test")
    return rows.select("project", "y", F.posexplode("cells").alias("pos", "value"))


def gene_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GENES)), "pos int, gene_id string")


def binary_tables(spark: SparkSession, sf: str) -> ModelTables:
    """Analytic two-class model over non-test samples."""
    stats = training_cells(spark, sf).groupBy("pos").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.avg(F.when(F.col("y") == 1, F.col("value"))).alias("tumor"), F.avg(F.when(F.col("y") == 0, F.col("value"))).alias("normal"),
    ).withColumn("scale", unit_if_zero("sd"))
    genes = stats.join(F.broadcast(gene_table(spark)), "pos").select("pos", "gene_id", "mean", "scale")
    coef = stats.select(F.lit(1).alias("class_idx"), "pos", ((F.col("tumor") - F.col("normal")) / F.col("scale")).alias("coef"))
    head = spark.createDataFrame([(0, "normal", 0.0), (1, "tumor", 0.0)], "class_idx int, class string, intercept double")
    return ModelTables(genes, coef, head, "binary")


def multiclass_tables(spark: SparkSession, sf: str) -> ModelTables:
    """Class = project, coefficient = (class mean - mean) / scale."""
    cells = training_cells(spark, sf)
    stats = cells.groupBy("pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).withColumn("scale", unit_if_zero("sd"))
    genes = stats.join(F.broadcast(gene_table(spark)), "pos").select("pos", "gene_id", "mean", "scale")
    head = cells.groupBy("project").agg(F.lit(0.0).alias("intercept")).select(
        F.substring("project", 7, 9).cast("int").alias("class_idx"), F.substring("project", 6, 9).alias("class"), "intercept"
    )
    coef = (
        cells.groupBy("project", "pos").agg(F.avg("value").alias("m")).join(F.broadcast(stats.select("pos", "mean", "scale")), "pos")
        .select(F.substring("project", 7, 9).cast("int").alias("class_idx"), "pos", ((F.col("m") - F.col("mean")) / F.col("scale")).alias("coef"))
    )
    return ModelTables(genes, coef, head, "multiclass")


def binary_model(spark: SparkSession, sf: str) -> LinearModel:
    t = binary_tables(spark, sf)
    # One row per gene, in one job.
    rows = sorted(t.genes.join(t.coef, "pos").collect(), key=lambda r: r["pos"])
    column = lambda c: tuple(r[c] for r in rows)
    return LinearModel(column("gene_id"), column("mean"), column("scale"), (column("coef"),), (0.0,), ("normal", "tumor"))


def multiclass_model(spark: SparkSession, sf: str) -> LinearModel:
    return collect_model(multiclass_tables(spark, sf))


# --- scores, phenotypes, files --------------------------------------------


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 3).alias("tumor_probability"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample"), F.when(F.col("quality") == 1, "Tumor").otherwise("normal").alias("label")
    )


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``sample, label (0/1), score`` of documents with a label."""
    y = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    s = table(spark, sf, "documents").select("doc_id", "lang", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 3).alias("score"))
    return y.join(s, "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample"), "label", "score", "lang")


def phenotype(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("GTEX-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("sample"),
        F.lit("GTEX").alias("study"), F.lit("Normal Tissue").alias("sample_type"), F.col("event_type").alias("primary_site"),
    )


def normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """An all-normal cohort: every event scored, with its site."""
    v = F.round(F.col("value") / (F.col("value") + 20.0), 4)
    return table(spark, sf, "events").select(
        F.concat(F.lit("GTEX-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("sample"),
        F.col("event_type").alias("primary_site"), v.alias("tumor_probability"), F.when(v >= 0.5, "tumor").otherwise("normal").alias("call"),
    )


def counts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_partkey") % 500
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("file_id"),
        F.concat(F.lit("ENSG"), F.lpad(key.cast("string"), 11, "0"), F.lit("."), (F.col("l_partkey") % 3 + 1).cast("string")).alias("gene_id"),
        F.col("l_quantity").alias("tpm"),
    )


def file_uuid(c: str):
    h = F.md5(F.concat(F.lit("file"), F.col(c).cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One provider file per order: case = customer, type by order key."""
    o = table(spark, sf, "orders")
    return o.select(
        file_uuid("o_orderkey").alias("file_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".tsv")).alias("file_name"),
        (F.col("o_orderkey") % 1000 + 1).alias("file_size"),
        F.md5(F.col("o_orderkey").cast("string")).alias("md5sum"),
        F.concat(F.lit("P-"), F.col("o_orderstatus")).alias("project"),
        F.concat(F.lit("case-"), F.col("o_custkey").cast("string")).alias("case_submitter_id"),
        F.concat(F.lit("bio-"), F.expr("o_orderkey div 2").cast("string")).alias("sample_submitter_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "Solid Tissue Normal").otherwise("Primary Tumor").alias("sample_type"),
        F.lit(1).alias("n_sample_types"),
    )


# Folders that provider files are dealt to, and the id in a file's path.
FOLDERS = 64
FILE_ID = r"file=([^/.]+)"


def write_files(texts: DataFrame, path: str) -> None:
    """A file for each row of ``texts`` (``file, value``), its whole text.

    Tasks write a mounted folder's files themselves: Spark's writer makes a folder and a
    checksum for each and starts two processes to set their modes. Where the path is none
    of a mounted folder, Spark's writer is used.
    """
    texts = texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "file")
    at = urlsplit(path)
    if at.scheme not in ("", "file"):
        texts.sortWithinPartitions("file").write.partitionBy("file").text(path)
        return

    def put(rows):
        for r in rows:
            folder = f"{at.path}/{zlib.crc32(r['file'].encode()) % FOLDERS:02d}"
            os.makedirs(folder, exist_ok=True)
            # Whole or not there, also when a task runs twice.
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r["value"] + "\n")
            os.replace(part, f"{folder}/file={r['file']}.tsv")

    texts.select("file", "value").foreachPartition(put)


def write_count_files(spark: SparkSession, sf: str, path: str) -> tuple[str, str]:
    """One count file per sample in TPM, and the provider's nested manifest of them."""
    e = table(spark, sf, "embeddings")
    own = e.select(file_uuid("vec_id").alias("file"), cell_values().alias("cells"))
    genes = F.array(*[F.lit(g) for g in GENES])
    line = lambda i, v: F.concat_ws("\t", F.get(genes, i), F.lit("sym"), F.lit("protein_coding"), F.round(F.pow(F.lit(2.0), v) - 1, 6).cast("string"))
    head = F.array(F.lit("# gene-model: test"), F.lit("gene_id\tgene_name\tgene_type\ttpm_unstranded"))
    write_files(own.select("file", F.array_join(F.concat(head, F.transform("cells", lambda v, i: line(i, v))), "\n").alias("value")), f"{path}/files")
    m = metadata_columns()
    sample = F.struct(F.concat(F.lit("bio-"), sample_id()).alias("submitter_id"), F.when(m["y"] == 1, "Primary Tumor").otherwise("Solid Tissue Normal").alias("sample_type"))
    case = F.struct(m["case_id"].alias("submitter_id"), F.struct(m["project"].alias("project_id")).alias("project"), F.array(sample).alias("samples"))
    hits = e.select(
        file_uuid("vec_id").alias("file_id"), F.concat(sample_id(), F.lit(".tsv")).alias("file_name"), F.lit(1000).cast("bigint").alias("file_size"),
        F.md5(sample_id()).alias("md5sum"), F.array(case).alias("cases"),
    )
    hits.write.json(f"{path}/manifest")
    return f"{path}/files", f"{path}/manifest"


def write_gene_files(spark: SparkSession, sf: str, path: str) -> tuple[str, str]:
    """Gene-by-sample files in log2(tpm+0.001), and a phenotype table: donor = case, site = project."""
    m = metadata_columns()
    name = F.concat(F.lit("GTEX-"), m["case_id"], F.lit("-"), F.col("vec_id").cast("string"))
    e = table(spark, sf, "embeddings")
    rows = e.select(name.alias("sample"), F.transform(cell_values(), lambda v: F.round(v - 2.0, 6)).alias("cells"))
    write_gene_rows(ExpressionMatrix(rows, GENES), f"{path}/genes", block=200, compression="gzip")
    told = e.select(name.alias("sample"), F.lit("GTEX").alias("_study"), F.lit("Normal Tissue").alias("_sample_type"), m["project"].alias("_primary_site"))
    told.write.csv(f"{path}/phenotype", sep="\t", header=True)
    return f"{path}/genes", f"{path}/phenotype"


def donors(df: DataFrame) -> DataFrame:
    return df.withColumn("donor_id", donor_id("sample"))


# --- the same views for DuckDB --------------------------------------------

EXPRESSION = """expression as (
  select 's'||lpad(cast(vec_id as varchar),6,'0') as sample, vec_id, p as pos,
         'ENSG'||lpad(cast(p as varchar),11,'0')||'.'||cast(p%9+1 as varchar) as gene_id,
         round(6.0+8.0*cast(embedding[p+1] as double),6) as value
  from embeddings, (select unnest(range(0,64)) as p) g)"""

METADATA = """metadata as (
  select 's'||lpad(cast(vec_id as varchar),6,'0') as sample, 'TCGA-T'||cast(label//2 as varchar) as project,
         case when label%2=1 then 'tumor' else 'normal' end as label, label%2 as y,
         'case'||cast((vec_id*10+label)//20 as varchar)||'_'||cast(label//2 as varchar) as case_id,
         'sub'||cast((vec_id*10+label)//20 as varchar)||'_'||cast(label//2 as varchar) as submitter_id,
         ((vec_id*10+label)//20)%5=0 as is_test
  from embeddings)"""

BINARY_MODEL = """model as (
  select pos, gene_id, avg(value) as mean, case when stddev_pop(value)=0 then 1 else stddev_pop(value) end as scale,
         (avg(value) filter (where y=1) - avg(value) filter (where y=0)) / (case when stddev_pop(value)=0 then 1 else stddev_pop(value) end) as coef
  from expression join metadata using (sample) where not is_test group by pos, gene_id)"""

MULTICLASS_MODEL = """gene_stats as (
  select pos, avg(value) as mean, case when stddev_pop(value)=0 then 1 else stddev_pop(value) end as scale
  from expression join metadata using (sample) where not is_test group by pos),
class_coef as (
  select substr(project,6) as class, cast(substr(project,7) as integer) as class_idx, pos, mean, scale, (avg(value)-mean)/scale as coef
  from expression join metadata using (sample) join gene_stats using (pos) where not is_test group by project, pos, mean, scale)"""

DEGRADED = """degraded as (
  select sample, pos, case when pos%2=0 then regexp_replace(gene_id,'\\.[0-9]+$','') else gene_id end as gene_id,
         case when (pos*31+vec_id)%97=0 then null else value end as value
  from expression where pos%7<>3)"""

LOGITS = """logits as (
  select sample, sum((value-mean)/scale*coef) as logit from expression join model using (pos) group by sample),
scored as (
  select sample, logit, case when logit>=0 then 1/(1+exp(-logit)) else exp(logit)/(1+exp(logit)) end as p from logits)"""

SCORES = """scores as (
  select 'd'||cast(doc_id as varchar) as sample, lang, round(n_chars/(n_chars+2000.0),3) as tumor_probability from documents)"""
LABELS = """label_table as (
  select 'd'||cast(doc_id as varchar) as sample, case when quality=1 then 'Tumor' else 'normal' end as label, quality as y from labels)"""
LABELLED = SCORES + ",\n" + LABELS + """,
labelled as (select s.sample, s.lang, l.y as label, s.tumor_probability as score from scores s join label_table l using (sample))"""

NORMALS = """normals as (
  select 'GTEX-'||cast(user_id as varchar)||'-'||cast(event_id as varchar) as sample, event_type as primary_site,
         round(value/(value+20.0),4) as tumor_probability from events)"""
PHENOTYPE = """phenotype as (
  select 'GTEX-'||cast(user_id as varchar)||'-'||cast(event_id as varchar) as sample, 'GTEX' as study,
         'Normal Tissue' as sample_type, event_type as primary_site from events)"""
COUNTS = """counts as (
  select 'f'||cast(l_orderkey as varchar)||'_'||cast(l_linenumber as varchar) as file_id,
         'ENSG'||lpad(cast(l_partkey%500 as varchar),11,'0')||'.'||cast(l_partkey%3+1 as varchar) as gene_id, l_quantity as tpm
  from lineitem)"""
MANIFEST = """manifest as (
  select h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32] as file_id, 'o'||cast(o_orderkey as varchar)||'.tsv' as file_name,
         o_orderkey%1000+1 as file_size, md5(cast(o_orderkey as varchar)) as md5sum, 'P-'||o_orderstatus as project,
         'case-'||cast(o_custkey as varchar) as case_submitter_id, 'bio-'||cast(o_orderkey//2 as varchar) as sample_submitter_id,
         case when o_orderkey%3=0 then 'Solid Tissue Normal' else 'Primary Tumor' end as sample_type, 1 as n_sample_types, o_orderkey
  from (select *, md5('file'||cast(o_orderkey as varchar)) as h from orders))"""


def with_views(*views: str, body: str) -> str:
    return "with " + ",\n".join(views) + "\n" + body
