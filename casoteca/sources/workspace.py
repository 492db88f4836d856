"""Shared folder for written tables, checkpoints and model files."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from casoteca.sources.session import wide_rows

_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; a cluster
    session without it is an error, because executors share no local disk.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_SETTING} to a folder that every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="casoteca-")
    return _local_roots[app]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, unused path under the shared folder (not created yet)."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/casoteca/{app}/{purpose}-{uuid.uuid4().hex[:12]}"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, when all is done, what ``cut_lineage`` has written inside, but for tables to keep."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            delete_path(spark, path)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as a table and read it back.

    Iterative fits read their input many times; a written table survives the
    loss of executors, unlike a cached one, and keeps column pruning. ``keep`` is
    for what outlasts ``passing_tables``.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    if not keep and (passing := _passing.get()) is not None:
        passing.append(path)
    with wide_rows(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _glob(spark: SparkSession, pattern: str) -> list:
    """Driver-side metadata call on the pattern's own file system."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.globStatus(glob) or [])


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob pattern."""
    return sorted(str(s.getPath()) for s in _glob(spark, pattern))


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(_glob(spark, path))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes when one of the paths is rewritten; reads file metadata only."""
    facts = [(str(s.getPath()), s.getLen(), s.getModificationTime())
             for p in sorted(paths) for s in _glob(spark, p)]
    return hashlib.md5(repr(facts).encode()).hexdigest()[:16]
