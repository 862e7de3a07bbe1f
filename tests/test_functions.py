import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import ids, numeric


def values(spark, column, inputs, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_strip_version(spark):
    given = ["ENSG00000005.6", "ENSG1", "HLA.DRA", "GENE.A.2", ".5", "a.", "x.1.2", "x.1b"]
    assert values(spark, ids.strip_version("v"), given) == ["ENSG00000005", "ENSG1", "HLA.DRA", "GENE.A", ".5", "a.", "x.1", "x.1b"]


def test_looks_like_gene(spark):
    assert values(spark, ids.looks_like_gene("v"), ["ENSG1", "ENSG1.2", "ENSG", "sample", "ENSGx"]) == [True, True, False, False, False]


def test_donor_id(spark):
    given = ["GTEX-1117F-0226-SM", "TCGA-AB-1234-01", "OTHER-1-2"]
    assert values(spark, ids.donor_id("v"), given) == ["GTEX-1117F", "TCGA-AB-1234", "OTHER-1-2"]


def test_normalize_label(spark):
    given = [" Tumor", "PRIMARY TUMOR", "1", "normal", "Solid Tissue Normal", "0", "maybe", "", None]
    assert values(spark, ids.normalize_label("v"), given) == [1, 1, 1, 0, 0, 0, None, None, None]
    # Texts count by spelling alone, numbers by value.
    assert values(spark, ids.normalize_label("v"), ["1.0", "1d", "1f", "0d", "01", "1e0"]) == [None] * 6
    assert values(spark, ids.normalize_label("v"), [1.0, 0.0, 0.5], "v double") == [1, 0, None]


def test_as_number(spark):
    assert values(spark, numeric.as_number("v"), ["0.5", "0.5d", "1f", " 1 ", None]) == [0.5, None, None, 1.0, None]
    assert values(spark, numeric.as_number("v"), [0.5, 2.0], "v double") == [0.5, 2.0]


def test_uuid_and_md5(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    assert values(spark, ids.valid_uuid("v"), [u, u.upper(), u.replace("-", ""), None]) == [True, True, False, False]
    assert values(spark, ids.valid_md5("v"), ["a" * 32, "A" * 32, "g" * 32, "a" * 31]) == [True, True, False, False]


def test_to_number(spark):
    given = ["1.5", " 2 ", "1e3", "-.5", "bad", "", "NA", "inf", "NaN", "1f", "1.5d", "1e999", None]
    assert values(spark, numeric.to_number("v"), given) == [1.5, 2.0, 1000.0, -0.5] + [None] * 9


def test_sigmoid_does_not_overflow(spark):
    got = values(spark, numeric.sigmoid("v"), [0.0, 1000.0, -1000.0, 2.0], "v double")
    assert got == pytest.approx([0.5, 1.0, 0.0, 1 / (1 + math.exp(-2))])


def test_softmax(spark):
    got = values(spark, numeric.softmax("v"), [[1000.0, 1000.0], [0.0, math.log(3.0)]], "v array<double>")
    assert got[0] == [0.5, 0.5]
    assert got[1] == pytest.approx([0.25, 0.75])


def test_decode_foreign_scale(spark):
    got = values(spark, numeric.decode_log2_tpm001("v"), [math.log2(0.001 - 1e-8), math.log2(1.001), math.log2(0.001 - 1e-5), math.nan], "v double")
    assert got[:2] == pytest.approx([0.0, 1.0]) and got[2:] == [None, None]


def test_sorted_quantile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.normal(size=n).tolist()) for n in (1, 2, 5, 64)]
    for p in (0.0, 0.5, 0.95, 1.0):
        got = values(spark, numeric.sorted_quantile(F.col("v"), p), rows, "v array<double>")
        assert got == pytest.approx([np.quantile(r, p) for r in rows])


def test_let_computes_once(spark):
    """A bound value is one plan node outside the lambda, whatever the array size."""
    df = spark.range(3).select(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i * F.col("id")).alias("v"))
    picked = df.select(numeric.gather("v", [3, 0, 9]).alias("p"))
    assert [r["p"] for r in picked.collect()] == [[0, 0, None], [4, 1, None], [8, 2, None]]


@pytest.mark.parametrize("bad", [True, -0.1, 1.1, float("nan"), "x", None])
def test_check_fraction(bad):
    with pytest.raises(ValueError):
        numeric.check_fraction(bad)


def test_preview(spark):
    got = values(spark, numeric.preview("v", 2), [["a"], ["a", "b", "c"]], "v array<string>")
    assert got == ["a", "a, b, ..."]
