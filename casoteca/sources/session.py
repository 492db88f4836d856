"""Session settings that the jobs of this package rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

# A case row has dozens of computed columns. Generated as one Java method they
# exceed the 8000 bytes the JVM is willing to compile and run interpreted. Below
# this limit Spark generates small methods instead.
_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_COMPILABLE = "8000"

SETTINGS = {
    _LIMIT: _COMPILABLE,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
}

# Shuffle files of a job stay on the executors' disks until the driver happens to collect its
# garbage. With this setting (Spark 4.1) they go when the job has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def wide_rows(spark: SparkSession) -> AbstractContextManager[None]:
    """Run a job over wide rows with compilable methods, then restore the setting."""
    return _setting(spark, _LIMIT, _COMPILABLE)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Run jobs whose shuffle files go at their end, then restore the setting.

    For results that are written or counted: a DataFrame that runs a second time under it
    has to shuffle again.
    """
    return _setting(spark, _FREE, "true")
