"""Patient-disjoint splits and the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import draw_key
from .checks import counted, offenders, union_all
from .ranking import hash_rank


def dependency_issues(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each ``key`` must go with exactly one ``value``.

    Min and max instead of a distinct count: two values per key and task.
    """
    bad = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")
    return offenders(bad, key, f"{key}->{value}", "not_unique")


def bijection_issues(df: DataFrame, a: str, b: str) -> DataFrame:
    return dependency_issues(df, a, b).unionByName(dependency_issues(df, b, a))


def leakage_issues(train: DataFrame, test: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Patients on both sides, per grouping column."""
    return union_all(
        [
            offenders(
                test.select(g).distinct().join(train.select(g).distinct(), g, "left_semi"), g, g, "leakage"
            )
            for g in groups
        ]
    )


def split_issues(samples: DataFrame, train: DataFrame, test: DataFrame, key: str = "sample", label: str = "label") -> DataFrame:
    """Train and test must be disjoint, duplicate-free, complete and two-class.

    One grouping by sample over the three inputs.
    """
    sides = (
        samples.select(key, label, F.lit(1).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"))
        .unionByName(train.select(key, F.lit(None).alias(label), F.lit(0).alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b")))
        .unionByName(test.select(key, F.lit(None).alias(label), F.lit(0).alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(key)
        .agg(F.max(label).alias(label), *[F.sum(c).alias(c) for c in ("s", "a", "b")])
    )
    t = sides.agg(
        F.count_if(F.col("a") > 1).alias("dup_train"),
        F.count_if(F.col("b") > 1).alias("dup_test"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("overlap"),
        F.count_if((F.col("s") == 0)).alias("out_of_range"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("uncovered"),
        F.count_distinct(F.when(F.col("a") > 0, F.col(label))).alias("train_classes"),
        F.count_distinct(F.when(F.col("b") > 0, F.col(label))).alias("test_classes"),
    )
    rows = [
        ("train", "duplicate", F.col("dup_train")),
        ("test", "duplicate", F.col("dup_test")),
        ("split", "overlap", F.col("overlap")),
        ("split", "out_of_range", F.col("out_of_range")),
        ("split", "uncovered", F.col("uncovered")),
        ("train", "single_class", F.when(F.col("train_classes") < 2, 1).otherwise(0)),
        ("test", "single_class", F.when(F.col("test_classes") < 2, 1).otherwise(0)),
    ]
    return t.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("check_name"), F.lit("ERROR").alias("level"), F.lit(code).alias("code"), n.cast("bigint").alias("n"), F.lit("").alias("examples"))
                    for c, code, n in rows
                ]
            )
        )
    )


def completeness_issues(df: DataFrame, columns: Sequence[str], check: str = "metadata") -> DataFrame:
    """No null or blank field after metadata was joined to samples."""
    return counted(
        df, {(check, "ERROR", f"incomplete_{c}"): F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}
    )


def reindex_metadata(samples: DataFrame, metadata: DataFrame, key: str = "sample") -> DataFrame:
    return samples.join(metadata, key, "left")


def grouped_stratified_folds(df: DataFrame, k: int, seed: int, group: str = "case_id", strata: Sequence[str] = ("project", "label")) -> DataFrame:
    """Fold per patient: all samples of a patient together, strata spread evenly.

    Patients with the same set of strata form a signature; inside it they are
    dealt round in hash order. A signature starts at its own fold, so the
    remainders of many small signatures do not pile up in fold 0.
    """
    stratum = F.concat_ws("_", *[F.col(c).cast("string") for c in strata])
    # A patient has few samples; the set is at most the number of strata.
    patients = df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(stratum)), "|").alias("signature"))
    ranked = hash_rank(patients, group, seed, ["signature"])
    start = F.conv(F.substring(draw_key(seed, "signature"), 1, 7), 16, 10).cast("bigint")
    return ranked.select(group, F.pmod(F.col("draw_rank") - 1 + start, F.lit(k)).cast("int").alias("fold"))


def with_folds(df: DataFrame, folds: DataFrame, group: str = "case_id") -> DataFrame:
    return df.join(folds, group)


def fold_balance(df: DataFrame, strata: Sequence[str] = ("project", "label")) -> DataFrame:
    """Samples and patients per fold and stratum."""
    return df.groupBy("fold", *strata).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("n_patients"))


def loco_splits(df: DataFrame, project: str = "project", label: str = "label", group: str = "case_id") -> DataFrame:
    """One row per held-out type: class counts on both sides, shared patients.

    Built from per-type totals. Both-side patients come from patients seen in
    more than one type, so no pairs of types are formed over samples.
    """
    per = df.groupBy(project).agg(
        F.count("*").alias("n_test"), F.count_if(F.col(label) == 1).alias("test_tumor"), F.count_if(F.col(label) == 0).alias("test_normal")
    )
    everything = Window.partitionBy(F.lit(0))
    # One row per cancer type from here on.
    totals = per.select(
        "*",
        (F.sum("n_test").over(everything) - F.col("n_test")).alias("n_train"),
        (F.sum("test_tumor").over(everything) - F.col("test_tumor")).alias("train_tumor"),
        (F.sum("test_normal").over(everything) - F.col("test_normal")).alias("train_normal"),
    )
    spread = df.groupBy(group).agg(F.min(project).alias("lo"), F.max(project).alias("hi")).where("lo <> hi").select(group)
    shared = df.select(group, project).distinct().join(spread, group, "left_semi").groupBy(project).agg(F.count("*").alias("shared_cases"))
    return totals.join(shared, project, "left").select(
        F.col(project).alias("held_out_type"), "n_train", "n_test", "train_tumor", "train_normal", "test_tumor", "test_normal",
        F.coalesce("shared_cases", F.lit(0)).alias("shared_cases"),
        valid_split().alias("valid"),
    )


def valid_split() -> Column:
    """Both classes on both sides and no shared patient."""
    both = (F.col("train_tumor") > 0) & (F.col("train_normal") > 0) & (F.col("test_tumor") > 0) & (F.col("test_normal") > 0)
    return both & (F.coalesce("shared_cases", F.lit(0)) == 0)
