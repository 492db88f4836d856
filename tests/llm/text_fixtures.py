"""What the tests of the text operators share."""

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Python workers started from now on find the package."""
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="module")
def frame(spark):
    """Documents with a NULL column and columns whose names clash with those of the operators."""
    def build(rows, ids="doc_id"):
        df = spark.createDataFrame(rows, f"{ids} long, text string")
        return df.selectExpr("*", "cast(null as string) as node", "1 as n", "'x' as row_", "2 as chunk").repartition(3)
    return build
