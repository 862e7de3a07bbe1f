"""Identifier and label columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label spellings accepted for each class.
TUMOR_LABELS = ("1", "tumor", "tumour", "primary tumor", "cancer", "positive", "pos", "true")
NORMAL_LABELS = ("0", "normal", "solid tissue normal", "healthy", "negative", "neg", "false")
# Class names accepted on a two-class model.
TUMOR_ROLES = ("1", "1.0", "true", "tumor", "tumour", "cancer", "positive", "pos")
NORMAL_ROLES = ("0", "0.0", "false", "normal", "healthy", "negative", "neg")
# Biospecimen types and their class, tumor side sampled in this order.
SAMPLE_TYPE_LABELS = {"Primary Tumor": 1, "Solid Tissue Normal": 0}


# An id with a version, and an id that names a gene; for Column expressions and names alike.
VERSIONED = r"^(.+)\.[0-9]+$"
GENE_ID = r"^ENSG[0-9]+(\.[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_version(c: Column | str) -> Column:
    """Drop one trailing all-digit ``.N``; other dots are part of the id."""
    return F.regexp_replace(_col(c), VERSIONED, "$1")


def looks_like_gene(c: Column | str) -> Column:
    return _col(c).rlike(GENE_ID)


def donor_id(c: Column | str) -> Column:
    """Donor part of a barcode: two fields for GTEX-, three for TCGA-."""
    c = F.trim(_col(c))
    return (
        F.when(c.startswith("GTEX-"), F.substring_index(c, "-", 2))
        .when(c.startswith("TCGA-"), F.substring_index(c, "-", 3))
        .otherwise(c)
    )


def project_code(c: Column | str) -> Column:
    """Type code behind ``TCGA-``; null when the form is wrong."""
    return F.when(_col(c).rlike("^TCGA-.+$"), F.substring(_col(c), 6, 1 << 20))


def normalize_label(c: Column | str) -> Column:
    """0/1 class of a label text; null when the spelling is unknown."""
    c = _col(c)
    text = F.lower(F.trim(c.cast("string")))
    # Texts are classes by their spelling alone; only numbers count by value.
    number = F.when(F.typeof(c) != "string", text.try_cast("double"))
    return (
        F.when(text.isin(*TUMOR_LABELS) | (number == 1), F.lit(1))
        .when(text.isin(*NORMAL_LABELS) | (number == 0), F.lit(0))
        .cast("int")
    )


def binary_role(c: Column | str) -> Column:
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.when(text.isin(*NORMAL_ROLES), F.lit("normal")).when(text.isin(*TUMOR_ROLES), F.lit("tumor"))


def valid_uuid(c: Column | str) -> Column:
    """Canonical hyphenated UUID, compared after trimming and lower-casing."""
    text = F.lower(F.trim(_col(c)))
    return F.coalesce(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def valid_md5(c: Column | str) -> Column:
    text = F.lower(F.trim(_col(c)))
    return F.coalesce(text.rlike("^[0-9a-f]{32}$"), F.lit(False))


def key_problem(c: Column | str) -> Column:
    """Why a value cannot be an identifier: missing, blank, padded; else null."""
    c = _col(c)
    return (
        F.when(c.isNull(), F.lit("missing"))
        .when(F.trim(c) == "", F.lit("blank"))
        .when(c != F.trim(c), F.lit("padded"))
    )


def draw_key(seed: int, c: Column | str) -> Column:
    """Reproducible random order: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(c).cast("string")))
