"""Validation cohorts: manifests, donor-disjoint draws, cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import SAMPLE_TYPE_LABELS, donor_id, draw_key, key_problem, strip_version, valid_md5, valid_uuid
from ..functions.numeric import as_number, is_finite
from ..session import materialize, small_side
from ..sources.matrix import ExpressionMatrix
from .checks import counted, require, require_columns, union_all, unique_key_issues
from .ranking import hash_rank

# Sample types allowed per study.
STUDY_TYPES = {"GTEX": ("Normal Tissue",), "TCGA": ("Solid Tissue Normal", "Primary Tumor")}


def type_label(sample_type: str = "sample_type") -> Column:
    c = F.lit(None).cast("int")
    for name, value in SAMPLE_TYPE_LABELS.items():
        c = F.when(F.col(sample_type) == name, value).otherwise(c)
    return c


# --- manifests -------------------------------------------------------------

# What a draw settles itself: types that are no class are left out, a class may be absent elsewhere.
DRAW_SETTLES = ("unsupported_sample_type", "single_class", "several_cases")


def provider_manifest_issues(df: DataFrame, project: str | None = None, strict: bool = True) -> DataFrame:
    """Rules of a per-file manifest; one pass for the row rules, one for the key.

    ``strict`` adds the rules for files that will be fetched: provider md5,
    a single case, file name and size, and a sample-type count.
    """
    have = set(df.columns)
    rules: dict[tuple[str, str, str], Column] = {}

    def rule(code, violated):
        rules["manifest", "ERROR", code] = F.coalesce(violated, F.lit(True))

    def unclean(c):
        return key_problem(c).isNotNull()

    for c in ("case_submitter_id", "project", "sample_type"):
        rule(f"unclean_{c}", unclean(c))
    rule("invalid_file_id", ~valid_uuid("file_id"))
    if project is not None:
        rule("other_project", F.col("project") != project)
    rule("unsupported_sample_type", ~F.col("sample_type").isin(*SAMPLE_TYPE_LABELS))
    if "label" in have:
        rule("label_disagrees", F.col("label").cast("string").try_cast("int") != type_label())
    if "n_sample_types" in have:
        rule("several_sample_types", F.col("n_sample_types").cast("string").try_cast("int") != 1)
    if strict:
        rule("several_cases", F.col("case_submitter_id").contains(";"))
    if "file_name" in have:
        rule("unclean_file_name", unclean("file_name"))
    if "file_size" in have:
        size = as_number("file_size")
        rule("invalid_file_size", ~(is_finite(size) & (size > 0) & (size == F.floor(size))))
    if "md5sum" in have:
        rule("invalid_md5", ~valid_md5("md5sum"))
    if strict:
        require_columns(df, ["file_name", "file_size", "md5sum", "n_sample_types"], "manifest")
    classes = df.agg(F.count_distinct(type_label()).alias("k")).select(
        F.lit("manifest").alias("check_name"), F.lit("ERROR").alias("level"), F.lit("single_class").alias("code"),
        F.when(F.col("k") < 2, 1).otherwise(0).cast("bigint").alias("n"), F.lit("").alias("examples"),
    )
    return union_all([counted(df, rules), unique_key_issues(df, "file_id"), unique_key_issues(df, "sample_submitter_id"), classes])


def phenotype_manifest_issues(df: DataFrame, study: str) -> DataFrame:
    """Rules of a locked phenotype cohort of one study."""
    if study not in STUDY_TYPES:
        raise ValueError(f"unknown study {study!r}; choose from {sorted(STUDY_TYPES)}")
    no = F.lit(True)
    rules = {
        ("manifest", "ERROR", "other_study"): F.coalesce(F.trim("study") != study, no),
        ("manifest", "ERROR", "blank_site"): F.coalesce(F.trim("primary_site") == "", no),
        ("manifest", "ERROR", "unsupported_sample_type"): ~F.coalesce(F.trim("sample_type").isin(*STUDY_TYPES[study]), F.lit(False)),
        ("manifest", "ERROR", "foreign_prefix"): ~F.coalesce(F.col("sample").startswith(f"{study}-"), F.lit(False)),
    }
    if "tissue" in df.columns and study == "GTEX":
        rules["manifest", "ERROR", "blank_tissue"] = F.coalesce(F.trim("tissue") == "", no)
    if "label" in df.columns and study == "TCGA":
        rules["manifest", "ERROR", "label_disagrees"] = F.coalesce(F.col("label").cast("int") != type_label(), no)
    return counted(df, rules).unionByName(unique_key_issues(df, "sample"))


def compare_locked(old: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "file_id", ignore_case: Sequence[str] = ()) -> DataFrame:
    """Per locked column: files gone from the provider, values changed."""
    j = old.alias("o").join(new.alias("n"), key, "left")
    gone = F.col(f"n.{columns[0]}").isNull()

    def text(side, c):
        v = F.col(f"{side}.{c}").cast("string")
        return F.lower(v) if c in ignore_case else v

    agg = j.agg(
        F.count_if(gone).alias("gone"),
        *[F.count_if(~gone & ~text("o", c).eqNullSafe(text("n", c))).alias(f"d_{c}") for c in columns],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col("gone").alias("n_missing"), F.col(f"d_{c}").alias("n_changed")) for c in columns])
    return agg.select(F.inline(rows))


# --- draws -----------------------------------------------------------------


def dedupe_first(df: DataFrame, order: str, *keys: str, within: Sequence[str] = ()) -> DataFrame:
    """First row by ``order`` per key (inside each of ``within``), one key after the other.

    ``min_by`` keeps one row per key in every task before the shuffle, so a key
    with a third of the rows costs no more than any other.
    """
    for key in keys:
        own = [*within, key]
        others = [c for c in df.columns if c not in own]
        df = (
            df.groupBy(*own)
            .agg(F.min_by(F.struct(*others), F.col(order)).alias("r"))
            .select(*[F.col(c) if c in own else F.col(f"r.{c}").alias(c) for c in df.columns])
        )
    return df


def exclude_used(part: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return part.join(used.select(key).distinct(), key, "left_anti")


def draw_in_turns(pool: DataFrame, turn: Column, group: str, donor: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group in reproducible random order, no donor twice.

    Groups with a smaller ``turn`` choose first. The result is that of drawing group by
    group, found for all groups at once: each group names its ``n`` best rows left, a
    donor named by several stays with the one whose turn comes first and leaves the
    others, and groups that lost a donor name their next, until nobody is named twice.
    What a donor holds only ever changes to an earlier turn, so later ones can be dropped
    for good. A round is two jobs, and chains of losses, not groups, number the rounds.
    A donor must have one row at most in a group. Every round is a written table.
    """
    left = materialize(pool.withColumns({"__turn": turn, "__draw": draw_key(seed, key)}), "draw-pool")
    order = Window.partitionBy(group).orderBy("__draw", key)
    while True:
        named = left.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n)
        holds = materialize(named.groupBy(donor).agg(F.min("__turn").alias("__held"), F.count("*").alias("__times")), "draw-holds")
        if holds.where("__times > 1").isEmpty():
            return named.select(*pool.columns)
        keeps = F.col("__held").isNull() | (F.col("__turn") <= F.col("__held"))
        left = materialize(left.join(holds.drop("__times"), donor, "left").where(keeps).drop("__held"), "draw-pool")


def sample_per_class(df: DataFrame, n_per_class: int, seed: int, key: str = "file_id", biospecimen: str | None = "sample_submitter_id", donor: str = "case_submitter_id", sample_type: str = "sample_type", disjoint: bool = True) -> DataFrame:
    """Up to n donors per class, tumor side first; a donor serves one class.

    Of several files per biospecimen, then per donor, the first by key counts, in each
    class by itself. A class without rows, or without a donor left, is an error.
    """
    if n_per_class <= 0:
        raise ValueError("n_per_class must be positive")
    own = df.where(F.col(sample_type).isin(*SAMPLE_TYPE_LABELS))
    first = dedupe_first(own, key, *([biospecimen] if biospecimen else []), donor, within=[sample_type]).withColumn("label", type_label(sample_type))
    if disjoint:
        turns = F.create_map(*[F.lit(x) for i, name in enumerate(SAMPLE_TYPE_LABELS) for x in (name, i)])
        drawn = draw_in_turns(first, turns[F.col(sample_type)], sample_type, donor, key, n_per_class, seed)
    else:
        order = Window.partitionBy(sample_type).orderBy(draw_key(seed, key), key)
        drawn = first.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n_per_class).drop("__place")
    drawn = materialize(drawn, "class-draw")
    there = {r[0] for r in drawn.select(sample_type).distinct().collect()}  # two classes
    for name in SAMPLE_TYPE_LABELS:
        if name not in there:
            raise ValueError(f"no {name!r} rows to draw from")
    return drawn


def draw_project_files(manifest: DataFrame, project: str, n_per_class: int, seed: int, disjoint: bool = True) -> DataFrame:
    """Draw one project's files out of a checked provider manifest."""
    rows = provider_manifest_issues(manifest).where(~F.col("code").isin(*DRAW_SETTLES))
    require(rows.where(~((F.col("check_name") == "sample_submitter_id") & (F.col("code") == "duplicate"))), "manifest")
    return sample_per_class(manifest.where(F.col("project") == project), n_per_class, seed, disjoint=disjoint)


def draw_study_samples(phenotype: DataFrame, study: str, n_per_class: int, seed: int, disjoint: bool = True) -> DataFrame:
    """Draw one study's samples out of a phenotype table; the donor comes from the barcode."""
    require(unique_key_issues(phenotype, "sample"), "phenotype")
    own = phenotype.where(F.col("study") == study).withColumn("donor_id", donor_id("sample"))
    return sample_per_class(own, n_per_class, seed, "sample", None, "donor_id", disjoint=disjoint)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(draw_key(seed, key), key)


def site_donors(phenotype: DataFrame, min_site_n: int) -> DataFrame:
    """First sample per donor and site, for sites with enough donors."""
    normals = phenotype.where((F.col("study") == "GTEX") & F.lower("sample_type").contains("normal")).withColumn("donor_id", donor_id("sample"))
    others = [c for c in normals.columns if c not in ("primary_site", "donor_id")]
    first = (
        normals.groupBy("primary_site", "donor_id")
        .agg(F.min_by(F.struct(*others), F.col("sample")).alias("r"))
        .select("primary_site", "donor_id", *[F.col(f"r.{c}").alias(c) for c in others])
    )
    sizes = first.groupBy("primary_site").agg(F.count("*").alias("site_donors"))
    # One row per tissue site.
    return first.join(sizes.where(F.col("site_donors") >= min_site_n), "primary_site")


def sample_per_site_overlapping(phenotype: DataFrame, n_per_site: int, min_site_n: int, seed: int) -> DataFrame:
    """Donors may serve several sites: every site is drawn in the same pass."""
    ranked = hash_rank(site_donors(phenotype, min_site_n), "sample", seed, ["primary_site"])
    return ranked.where(F.col("draw_rank") <= n_per_site).drop("draw_key", "draw_rank")


def sample_per_site(phenotype: DataFrame, n_per_site: int, min_site_n: int, seed: int) -> DataFrame:
    """Donor-disjoint draws, rarest site first, as ``draw_in_turns``."""
    if n_per_site <= 0 or min_site_n <= 0:
        raise ValueError("n_per_site and min_site_n must be positive")
    pool = site_donors(phenotype, min_site_n)
    drawn = materialize(draw_in_turns(pool, F.struct("site_donors", "primary_site"), "primary_site", "donor_id", "sample", n_per_site, seed), "site-draw")
    counts = drawn.groupBy("primary_site").agg(F.count("*").alias("n"))
    sites = pool.select("primary_site").distinct().join(counts, "primary_site", "left").select("primary_site", F.coalesce("n", F.lit(0)).alias("n"))
    short = F.min_by(F.struct("primary_site", "n"), F.struct("n", "primary_site"))
    total, worst = sites.agg(F.count("*"), short).first()
    if not total:
        raise ValueError("no site has enough donors")
    if worst["n"] < min(n_per_site, min_site_n):
        raise ValueError(f"site {worst['primary_site']!r} has only {worst['n']} unused donors left")
    return drawn


def class_cap(df: DataFrame, ratio: int = 2, group: str = "project", label: str = "label", key: str = "sample", seed: int = 0) -> DataFrame:
    """Per type, tumors (label 1) capped at ``ratio`` times the normals.

    Only keys are ranked; whole rows are filtered in place, without a shuffle.
    """
    narrow = df.select(group, label, key)
    ranked = hash_rank(narrow.where(F.col(label) == 1), key, seed, [group])
    normals = narrow.where(F.col(label) == 0).groupBy(group).agg(F.count("*").alias("n_normal"))
    # One row per cancer type: the last tumor that still fits.
    cut = ranked.join(normals, group).where(F.col("draw_rank") <= ratio * F.col("n_normal")).groupBy(group).agg(
        F.max(F.struct(F.col("draw_key").alias("k"), F.col(key).cast("string").alias("i"))).alias("cut")
    )
    own = F.struct(draw_key(seed, key).alias("k"), F.col(key).cast("string").alias("i"))
    fits = (F.col(label) == 0) | F.coalesce(own <= F.col("cut"), F.lit(False))
    return df.join(small_side(cut), group, "left").where(fits).select(*df.columns)


def expressed_genes(cells: DataFrame, min_tpm: float = 1.0, min_fraction: float = 0.2, gene: str = "gene_id", tpm: str = "tpm") -> DataFrame:
    """Genes above ``min_tpm`` in more than ``min_fraction`` of their samples."""
    return (
        cells.groupBy(gene)
        .agg(F.count("*").alias("n"), F.avg(F.when(F.col(tpm) > min_tpm, 1.0).otherwise(0.0)).alias("expressed_fraction"))
        .where(F.col("expressed_fraction") > min_fraction)
    )


def genes_of_biotype(genes: DataFrame, annotation: DataFrame, biotypes: Sequence[str] = ("protein_coding",), gene: str = "gene_id", biotype: str = "gene_type") -> DataFrame:
    """Rows of ``genes`` whose annotation has one of the biotypes.

    An id counts as it stands where the annotation has it, else without its version. A
    repeated id counts if one of its rows does; genes without annotation go.
    """
    told = annotation.select(F.col(gene).alias("__id"), F.coalesce(F.col(biotype).isin(*biotypes), F.lit(False)).alias("__is"))
    exact = told.groupBy("__id").agg(F.bool_or("__is").alias("__exact"))
    base = told.groupBy(strip_version("__id").alias("__base")).agg(F.bool_or("__is").alias("__loose"))
    found = genes.join(exact, F.col(gene) == F.col("__id"), "left").join(base, strip_version(gene) == F.col("__base"), "left")
    return found.where(F.coalesce("__exact", "__loose")).select(*genes.columns)


# --- scores on cohorts -----------------------------------------------------


def attach_scores(manifest: DataFrame, scores: DataFrame, key: str = "sample") -> DataFrame:
    """Left join; ``require_complete`` says whether every row got one score."""
    return manifest.join(scores.select(F.col("sample").alias(key), "tumor_probability", "call"), key, "left")


def merge_completeness(manifest: DataFrame, merged: DataFrame, score: str = "tumor_probability") -> DataFrame:
    tagged = manifest.select(F.lit(0).alias("side"), F.lit(None).cast("double").alias("s")).unionByName(
        merged.select(F.lit(1).alias("side"), F.col(score).alias("s"))
    )
    return tagged.agg(
        F.count_if(F.col("side") == 0).alias("n_expected"),
        F.count_if(F.col("side") == 1).alias("n_merged"),
        F.count_if((F.col("side") == 1) & F.col("s").isNull()).alias("n_unscored"),
    ).withColumn("complete", (F.col("n_expected") == F.col("n_merged")) & (F.col("n_unscored") == 0))


def require_complete(manifest: DataFrame, merged: DataFrame, context: str) -> None:
    r = merge_completeness(manifest, merged).head()
    if not r["complete"]:
        raise ValueError(f"{context}: {r['n_merged']} rows for {r['n_expected']} samples, {r['n_unscored']} without a score")


def group_audit(df: DataFrame, id_column: str, group_column: str | None) -> DataFrame:
    """Rows, distinct ids and groups, repeated groups, largest group."""
    if group_column is None or group_column not in df.columns:
        return df.agg(F.count("*").alias("n_rows"), F.count_distinct(id_column).alias("n_unique_ids")).select(
            "*", *[F.lit(None).cast("bigint").alias(c) for c in ("n_unique_groups", "n_repeated_groups", "max_rows_per_group")]
        )
    groups = (
        df.select(F.trim(F.col(group_column).cast("string")).alias("g")).where("g is not null and g <> ''").groupBy("g").agg(F.count("*").alias("k"))
        .agg(
            F.count("*").alias("n_unique_groups"),
            F.count_if(F.col("k") > 1).alias("n_repeated_groups"),
            F.coalesce(F.max("k"), F.lit(0)).alias("max_rows_per_group"),
        )
    )
    totals = df.agg(F.count("*").alias("n_rows"), F.count_distinct(id_column).alias("n_unique_ids"))
    merged = totals.unionByName(groups, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def biospecimen_audit(df: DataFrame, column: str = "sample_submitter_id") -> DataFrame:
    return df.agg(
        F.count_distinct(F.col(column).cast("string")).alias("n_unique_biospecimens"),
        F.count_if(F.col(column).contains(";")).alias("n_ambiguous_biospecimen_ids"),
    )


def highest_scoring(df: DataFrame, n: int = 20, score: str = "tumor_probability", key: str = "sample") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


# --- unions ----------------------------------------------------------------


def union_cohorts(cohorts: Sequence[ExpressionMatrix]) -> ExpressionMatrix:
    """Stack cohorts with different gene sets; absent cells become null.

    The gene axes are merged on the driver and each cohort is re-gathered row by
    row, so no shuffle is needed.
    """
    genes = list(dict.fromkeys(g for c in cohorts for g in c.genes))
    parts = []
    for c in cohorts:
        at = {g: i for i, g in enumerate(c.genes)}
        parts.append(c.rows.select("sample", c.select_genes([at.get(g, -1) for g in genes]).alias("cells")))
    return ExpressionMatrix(union_all(parts), tuple(genes))


def union_predictions(parts: Sequence[DataFrame], expected: DataFrame, key: str = "sample") -> DataFrame:
    """Out-of-fold parts as one written table that covers every sample once.

    Written before it is checked, so the parts are computed once.
    """
    merged = materialize(union_all(parts), "predictions")
    counts = merged.groupBy(key).agg(F.count("*").alias("copies"))
    gaps = expected.select(key, F.lit(1).alias("wanted")).join(counts, key, "full_outer").agg(
        F.count_if(F.col("copies").isNull() | F.col("wanted").isNull()).alias("uncovered"), F.count_if(F.col("copies") > 1).alias("repeated")
    ).head()
    if gaps["uncovered"] or gaps["repeated"]:
        raise ValueError(f"predictions miss {gaps['uncovered']} samples and repeat {gaps['repeated']}")
    return merged


# --- external validation ---------------------------------------------------


def validate_labelled(manifest: DataFrame, scores: DataFrame, preset: str, key: str = "sample", threshold: float = 0.5) -> dict[str, DataFrame]:
    """Summary, sweep, per-type tables and audits of a labelled cohort.

    ``manifest`` has the key, ``label``, ``sample_type`` and ``donor_id``.
    """
    from .metrics import by_sample_type_summary, labelled_summary, preset_sweep, score_quantiles

    merged = attach_scores(manifest, scores, key)
    require_complete(manifest, merged, "score merge")
    return {
        "predictions": merged,
        "summary": labelled_summary(merged, threshold, "label", "tumor_probability"),
        "sweep": preset_sweep(merged, preset, "label", "tumor_probability"),
        "by_type": by_sample_type_summary(merged, threshold=threshold),
        "quantiles": score_quantiles(merged),
        "audit": group_audit(manifest, key, "donor_id"),
    }


def validate_all_normal(manifest: DataFrame, scores: DataFrame, key: str = "sample", threshold: float = 0.5) -> dict[str, DataFrame]:
    from .metrics import all_normal_summary, by_site_summary, fpr_sweep

    merged = attach_scores(manifest, scores, key)
    require_complete(manifest, merged, "score merge")
    return {
        "predictions": merged,
        "summary": all_normal_summary(merged, threshold),
        "sweep": fpr_sweep(merged, "tumor_probability"),
        "by_site": by_site_summary(merged, threshold=threshold),
        "top": highest_scoring(merged, 20),
        "audit": group_audit(manifest, key, "donor_id"),
    }
