from __future__ import annotations

import pathlib
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from cohortloom.operators.model import make_model  # noqa: E402
from cohortloom.sources.matrix import ExpressionMatrix  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def matrix(spark):
    """Build a matrix from ``{sample: [cells]}``; text when any cell is text."""

    def build(genes, rows, text=None):
        text = text if text is not None else any(isinstance(c, str) for r in rows.values() for c in r)
        kind = "string" if text else "double"
        data = [(s, [None if c is None else (str(c) if text else float(c)) for c in cells]) for s, cells in rows.items()]
        return ExpressionMatrix(spark.createDataFrame(data, f"sample string, cells array<{kind}>"), tuple(genes))

    return build


@pytest.fixture(scope="session")
def tiny_model():
    return make_model(["g1", "g2"], [0.0, 0.0], [1.0, 1.0], [1.0, -1.0], 0.0)


@pytest.fixture(scope="session")
def labelled(spark):
    def build(y, s, **extra):
        names = ["label", "score", *extra]
        rows = list(zip(y, map(float, s), *extra.values()))
        df = spark.createDataFrame(rows, names)
        return df.withColumn("label", F.col("label").cast("int"))

    return build
