"""Expression matrices: samples x genes, any number of samples.

A wide file keeps one row per sample with all its cells in one array. The gene
axis is the header, resolved once on the driver; no wide Spark schema is ever
made, so 60,000 gene columns cost no more planning than 60.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.ids import GENE_ID, strip_version
from ..functions.numeric import finite_or_null, gather, int_array, let, to_number
from ..session import materialize, small_side
from ..operators.checks import offenders, require, union_all, unique_key_issues

DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
# Genes that an axis found in the data may have.
MAX_AXIS = 1_000_000
# Characters of all heads together that are broadcast; parts of a file beyond that.
HEAD_CHARS = 64 << 20
HEAD_SALTS = 64
# A separator that cannot occur in text: a whole line is read as one CSV field.
_WHOLE_LINE = "\u0001"


@dataclass(frozen=True)
class ExpressionMatrix:
    """``rows(sample string, cells array<string|double>)`` plus the gene header."""

    rows: DataFrame
    genes: tuple[str, ...]

    @property
    def text_cells(self) -> bool:
        return isinstance(self.rows.schema["cells"].dataType.elementType, T.StringType)

    def numbers(self, cell: Column) -> Column:
        return to_number(cell) if self.text_cells else finite_or_null(cell)

    def select_genes(self, positions: Sequence[int]) -> Column:
        """Numbers at the given header positions; -1 yields null."""
        if list(positions) == list(range(len(self.genes))):
            return F.transform("cells", self.numbers)
        return F.transform(gather("cells", positions), self.numbers)

    def header(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(list(enumerate(self.genes)), "pos int, gene_id string")

    def long(self) -> DataFrame:
        """``(sample, pos, gene_id, value)``, value null where not a finite number."""
        cells = self.rows.select("sample", F.posexplode("cells").alias("pos", "cell"))
        return cells.join(F.broadcast(self.header()), "pos").select(
            "sample", "pos", "gene_id", self.numbers(F.col("cell")).alias("value")
        )


def header_issues(genes: Sequence[str], id_name: str | None = None) -> list[str]:
    """Problems of a gene header; it is one row, held on the driver."""
    issues = []
    if not genes:
        issues.append("at least one gene column is needed")
    if any(not g or not g.strip() for g in genes):
        issues.append("gene identifiers must be non-empty")
    padded = [g for g in genes if g and g.strip() and g != g.strip()]
    if padded:
        issues.append(f"gene identifiers must not be padded: {padded[:5]}")
    repeated = sorted(g for g, n in Counter(g.strip() for g in genes if g).items() if n > 1)
    if repeated:
        issues.append("duplicate gene columns: " + ", ".join(repeated[:5]))
    if id_name is not None and re.match(GENE_ID, id_name.strip()):
        issues.append("the first column looks like a gene, not a sample identifier; is the matrix transposed?")
    return issues


def header_problems(header: DataFrame) -> DataFrame:
    """The same rules over a header table ``(pos, gene_id)``, one row per rule."""
    trimmed = header.select("pos", F.trim("gene_id").alias("gene_id"))
    repeated = trimmed.groupBy("gene_id").count().where("count > 1")
    return union_all(
        [
            offenders(trimmed.where("gene_id = '' or gene_id is null"), "pos", "header", "blank_gene"),
            offenders(repeated, "gene_id", "header", "duplicate_gene"),
            offenders(header.where("pos = 0").where(F.col("gene_id").rlike(GENE_ID)), "gene_id", "header", "gene_like_id_column"),
        ]
    )


def _require_header(genes: Sequence[str], id_name: str | None, path: str) -> None:
    issues = header_issues(genes, id_name)
    if issues:
        raise ValueError(f"expression matrix {path}: " + "; ".join(issues))


def split_fields(line: Column, sep: str) -> Column:
    """Fields of a delimited line; only lines with quotes take the slower pattern."""
    fields = F.regexp_extract_all(
        F.concat(F.lit(sep), line), F.lit(f'{sep}("(?:[^"]|"")*+"(?={sep}|$)|[^{sep}]*)'), F.lit(1)
    )
    unquoted = F.transform(
        fields,
        lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f),
    )
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, sep))


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def read_matrix(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    transpose: bool = False,
    index_col: int | str = 0,
    check_samples: bool = True,
) -> ExpressionMatrix:
    """Read csv, tsv, txt or parquet: one file, or a folder of parts with one header."""
    kind = ("." + fmt.lstrip(".")) if fmt else _extension(path)
    if kind == ".parquet":
        matrix = _read_parquet(spark, path, transpose, index_col)
    elif kind in DELIMITERS and transpose:
        axis = gene_axis(spark, path, DELIMITERS[kind])
        _require_header(axis, None, path)
        matrix = matrix_from_long(gene_row_cells(spark, path, DELIMITERS[kind]), axis, value="cell")
    elif kind in DELIMITERS:
        matrix = _read_delimited(spark, path, DELIMITERS[kind], index_col)
    else:
        raise ValueError("unsupported expression matrix format; use .csv, .tsv, .txt or .parquet")
    if check_samples:
        if matrix.rows.isEmpty():
            raise ValueError(f"expression matrix {path}: at least one sample is needed")
        require(unique_key_issues(matrix.rows, "sample"), f"expression matrix {path}")
    return matrix


def _read_delimited(spark: SparkSession, path: str, sep: str, index_col: int | str) -> ExpressionMatrix:
    first = spark.read.text(path).head()
    if first is None or not first[0].strip("﻿"):
        raise ValueError(f"delimited file {path} is empty")
    header = next(csv.reader([first[0].lstrip("﻿").rstrip("\r")], delimiter=sep))
    at = _index_position(header, index_col, path)
    axis = [h for i, h in enumerate(header) if i != at]
    _require_header(axis, header[at], path)
    # The CSV source compares each part's first line with the header and hands over the others whole.
    schema = T.StructType([T.StructField(first[0].rstrip("\r"), T.StringType())])
    lines = spark.read.csv(path, schema=schema, sep=_WHOLE_LINE, quote="", header=True, enforceSchema=False).toDF("line")
    lines = lines.select(F.regexp_replace("line", "\r$", "").alias("line"))
    fields = lines.select("line", split_fields(F.col("line"), sep).alias("f"))
    sample = F.get("f", F.lit(at))
    if at == 0:
        # Checks that need only the id do not take the line apart.
        sample = F.when(F.col("line").contains('"'), sample).otherwise(F.substring_index("line", sep, 1))
    cells = F.slice("f", 2, len(axis)) if at == 0 else gather("f", [i for i in range(len(header)) if i != at])
    odd = F.raise_error(F.concat(F.lit(f"expression matrix {path}: the header has {len(header)} fields, a row "), F.size("f").cast("string")))
    cells = F.when(F.size("f") != len(header), odd).otherwise(cells)
    return ExpressionMatrix(fields.select(sample.alias("sample"), cells.alias("cells")), tuple(axis))


def _index_position(header: Sequence[str], index_col: int | str, path: str) -> int:
    if isinstance(index_col, str):
        if index_col not in header:
            raise ValueError(f"sample identifier column {index_col!r} was not found in {path}")
        return list(header).index(index_col)
    if not -len(header) <= index_col < len(header):
        raise ValueError(f"index_col {index_col} is outside the columns of {path}")
    return index_col % len(header)


def _gene_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row_id, line`` of every line that is not empty."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        F.regexp_replace("value", "^﻿|\r$", "").alias("line"),
    )
    return lines.where("line <> ''")


def _heads(lines: DataFrame, sep: str) -> DataFrame:
    """``file, head_line, head``: a file's first line, in the split that starts at byte 0."""
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("line", "row_id").alias("head_line"))
    return materialize(first.select("file", "head_line", split_fields(F.col("head_line"), sep).alias("head")), "heads")


def _with_heads(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Each line beside its file's head, with no file's lines in one task.

    Lines are spread by their text, as a gzip file arrives as one split. Heads that
    are small together are broadcast; others are repeated for ``HEAD_SALTS`` parts of
    a file, which its lines are dealt to.
    """
    size = heads.agg(F.sum(F.length("head_line"))).head()[0] or 0
    if size <= HEAD_CHARS:
        return lines.repartition("file", "line").join(F.broadcast(heads), "file")
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HEAD_SALTS - 1))))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(HEAD_SALTS)).cast("int"))
    return dealt.join(salted, ["file", "salt"]).drop("salt")


def gene_row_cells(spark: SparkSession, path: str, sep: str = "\t", genes: DataFrame | None = None) -> DataFrame:
    """Cells of gene-by-sample files as ``(file, gene_id, sample, cell)``.

    A cohort may come as many files, each with its own block of samples. The
    header of a file is its first line. Empty lines are skipped; a blank gene id is
    the empty text. ``genes(gene_id)`` keeps only wanted rows before cells are
    expanded.
    """
    lines = _gene_lines(spark, path)
    heads = _heads(lines, sep)
    if genes is not None:
        # The id field ends at the first separator; no full split for unwanted rows.
        wanted = small_side(genes.select(strip_version("gene_id").alias("base")).distinct())
        lines = lines.withColumn("gene_id", F.trim(F.substring_index("line", sep, 1))).join(wanted, strip_version("gene_id") == F.col("base"), "left_semi")
    body = _with_heads(lines.select("file", "line"), heads).where("line <> head_line").select("file", "head", split_fields(F.col("line"), sep).alias("f"))
    width = F.greatest(F.size("head"), F.size("f"))
    pairs = F.arrays_zip(F.slice("head", F.lit(2), width).alias("sample"), F.slice("f", F.lit(2), width).alias("cell"))
    gene = F.get("f", F.lit(0))
    gene = F.when(F.trim(gene) == "", F.lit("")).otherwise(gene)
    return body.select("file", gene.alias("gene_id"), F.explode(pairs).alias("c")).select("file", "gene_id", F.col("c.sample"), F.col("c.cell"))


def gene_axis(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Genes of gene-by-sample files in the order of their first appearance."""
    lines = _gene_lines(spark, path)
    heads = _heads(lines, sep)
    rows = lines.select("line", F.struct("file", "block", "row_id").alias("place")).join(F.broadcast(heads.select("head_line").distinct()), F.col("line") == F.col("head_line"), "left_anti")
    genes = rows.groupBy(F.get(split_fields(F.col("line"), sep), F.lit(0)).alias("g")).agg(F.min("place").alias("place"))
    return _bounded_axis(genes.orderBy("place").select("g"))


def _bounded_axis(genes: DataFrame) -> list[str]:
    """The gene axis on the driver, refused where it is no gene axis by its length."""
    axis = [r[0] for r in genes.limit(MAX_AXIS + 1).collect()]
    if len(axis) > MAX_AXIS:
        raise ValueError(f"more than {MAX_AXIS} genes; is the matrix the other way round?")
    return axis


def matrix_from_long(
    df: DataFrame, genes: Sequence[str] | None, sample: str = "sample", gene: str = "gene_id", value: str = "value"
) -> ExpressionMatrix:
    """One dense row per sample from long cells; absent cells are null.

    The one shuffle is on the sample, whose group is as long as the gene axis.
    A repeated (sample, gene) fails the job, whatever the session's rule for map keys.
    """
    spark = df.sparkSession
    if genes is None:
        genes = _bounded_axis(df.select(F.col(gene).alias("g")).distinct().orderBy("g"))
        _require_header(genes, None, "long cells")
    axis = spark.createDataFrame(list(enumerate(genes)), "pos int, axis_gene string")
    at = int_array(range(len(genes)))
    repeated = F.concat(F.lit("sample "), F.coalesce("sample", F.lit("null")), F.lit(" has a gene twice"))
    rows = (
        df.select(F.col(sample).alias("sample"), F.col(gene).alias("axis_gene"), F.col(value).alias("v"))
        .join(F.broadcast(axis), "axis_gene")
        .groupBy("sample")
        .agg(F.collect_list(F.struct("pos", "v")).alias("e"))
        .select("sample", F.when(F.size(F.array_distinct("e.pos")) == F.size("e"), F.map_from_entries("e")).otherwise(F.raise_error(repeated)).alias("m"))
        .select("sample", let("m", lambda m: F.transform(at, lambda i: F.try_element_at(m, i))).alias("cells"))
    )
    return ExpressionMatrix(rows, tuple(genes))


def _read_parquet(spark: SparkSession, path: str, transpose: bool, index_col: int | str) -> ExpressionMatrix:
    df = spark.read.parquet(path)
    stored = [c for c in df.columns if c.startswith("__index_level_")]
    at = df.columns.index(stored[0]) if stored and index_col == 0 else _index_position(df.columns, index_col, path)
    id_name, axis = df.columns[at], [c for i, c in enumerate(df.columns) if i != at]
    if transpose:
        cells = df.select(
            F.col(f"`{id_name}`").cast("string").alias("gene_id"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(f"`{c}`").cast("double").alias("v")) for c in axis])).alias("c"),
        )
        return matrix_from_long(cells.select("gene_id", "c.sample", "c.v"), None, value="v")
    _require_header(axis, None if stored else id_name, path)
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in axis)
    cells = [F.col(f"`{c}`").cast("double" if numeric else "string") for c in axis]
    return ExpressionMatrix(
        df.select(F.col(f"`{id_name}`").cast("string").alias("sample"), F.array(*cells).alias("cells")), tuple(axis)
    )


def read_parquet_genes(spark: SparkSession, path: str, genes: Sequence[str], index_col: int | str = 0) -> ExpressionMatrix:
    """Parquet matrix with only the wanted gene columns read from disk.

    Genes match by exact name, else without version, as the aligner does.
    """
    from ..operators.align import match_positions

    df = spark.read.parquet(path)
    at = _index_position(df.columns, index_col, path)
    axis = [c for i, c in enumerate(df.columns) if i != at]
    _require_header(axis, df.columns[at], path)
    kept = [axis[i] for i in sorted(set(match_positions(axis, genes))) if i >= 0]
    return ExpressionMatrix(
        df.select(
            F.col(f"`{df.columns[at]}`").cast("string").alias("sample"),
            F.array(*[F.col(f"`{c}`").cast("double") for c in kept]).cast("array<double>").alias("cells"),
        ),
        tuple(kept),
    )


def write_matrix(matrix: ExpressionMatrix, path: str, fmt: str = "csv", id_name: str = "sample") -> str:
    """Write wide text parts, each with the header line, or a parquet table."""
    if fmt == "parquet":
        matrix.rows.select(
            F.col("sample").alias(id_name), *[F.get("cells", F.lit(i)).alias(g) for i, g in enumerate(matrix.genes)]
        ).write.parquet(path)
        return path
    sep = DELIMITERS["." + fmt]
    body = matrix.rows.select(
        F.concat_ws(sep, "sample", F.transform("cells", lambda x: F.coalesce(x.cast("string"), F.lit("")))).alias("value")
    )
    # The only column is named after the header, so every part starts with it.
    body.toDF(sep.join([id_name, *matrix.genes])).write.csv(
        path, sep=_WHOLE_LINE, quote="", header=True, emptyValue=""
    )
    return path


def write_gene_rows(matrix: ExpressionMatrix, path: str, block: int = 1000, compression: str = "none") -> str:
    """Write gene-by-sample files, one per block of about ``block`` samples.

    A line holds one gene of one block, so its length does not grow with the
    cohort.
    """
    n_blocks = max(1, -(-matrix.rows.count() // block))
    cells = matrix.rows.select(
        F.pmod(F.xxhash64("sample"), F.lit(n_blocks)).alias("block"), "sample", F.posexplode("cells").alias("pos", "cell")
    )
    genes = cells.groupBy("block", "pos").agg(F.array_sort(F.collect_list(F.struct("sample", "cell"))).alias("c"))
    names = F.array(*[F.lit(g) for g in matrix.genes])
    body = genes.select(
        "block",
        (F.col("pos") + 1).alias("at"),
        F.concat_ws("\t", F.get(names, F.col("pos")), F.transform("c", lambda x: F.coalesce(x["cell"].cast("string"), F.lit("")))).alias("value"),
    )
    heads = genes.where("pos = 0").select(
        "block", F.lit(0).alias("at"), F.concat_ws("\t", F.lit("sample"), F.transform("c", lambda x: x["sample"])).alias("value")
    )
    (
        heads.unionByName(body)
        .repartition("block")
        .sortWithinPartitions("block", "at")
        .select("block", "value")
        .write.partitionBy("block")
        .option("compression", compression)
        .text(path)
    )
    return path
