"""Ingest jobs: yearly raw files to the case table, its quality report and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casoteca.operators.cleaning import transform_cases, validate_year
from casoteca.operators.quality import observed_report, watched
from casoteca.sources import files
from casoteca.sources.workspace import delete_path, path_exists

_COPIES = "__copias"


def pending_files(found: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Raw files that are new or have changed since the manifest was written; ``force``: all of them."""
    return found if force else found.join(manifest, ["ano", "arquivo", "bytes", "modificado"], "left_anti")


def ingest_years(spark: SparkSession, inputs: dict[int, str | list[str]], case_root: str,
                 quality_root: str, multi_line: bool = False,
                 encoding: str = "ISO-8859-1") -> list[int]:
    """Clean and write several years in one job, with their quality report and manifest.

    The raw files are read once: the job that writes the cases also observes the
    numbers of the report. A year whose file has no records replaces what was stored by nothing, and
    its report counts zeros. ``multi_line`` and ``encoding`` go to ``csv_scan``.

    Years keep their own columns until the union, so a column one year lacks
    is NULL there and never a negative answer. Copies are removed within each
    year, hence every output task belongs to one year and writes one file.
    A job that ends before the manifest is written is run again by the next ``ingest_all``.
    """
    if not inputs:
        return []
    before = files.input_files(spark, {validate_year(y): p for y, p in sorted(inputs.items())})
    parts, seen = [], {}
    for year, path in sorted(inputs.items()):
        raw = files.csv_scan(spark, path, multi_line=multi_line, encoding=encoding)
        part, seen[year] = watched(transform_cases(raw, year, copies=_COPIES), _COPIES)
        parts.append(part)
    files.write_cases(files.union_by_name(parts), case_root)
    report = observed_report(spark, seen)
    for row in report.collect():        # a row per year
        if not row["registros_processados"]:
            delete_path(spark, f"{case_root}/ANO={row['ano']}")
    files.write_quality(report, quality_root)
    files.write_manifest(before.join(report, "ano").select(
        *before.columns, "registros_recebidos", "registros_processados"), case_root)
    return list(seen)


def ingest_year(spark: SparkSession, path: str | list[str], case_root: str, quality_root: str,
                year: int, force: bool = False, **options) -> list[int]:
    """One year; an already stored year is an error unless ``force``."""
    validate_year(year)
    if not force and year in files.stored_years(spark, case_root):
        raise FileExistsError(f"O ano {year} existe; force=True o substitui.")
    return ingest_years(spark, {year: path}, case_root, quality_root, **options)


def ingest_all(spark: SparkSession, raw_root: str, case_root: str, quality_root: str,
               force: bool = False, **options) -> list[int]:
    """Every supported year with a raw file that is new or has changed; all of them with ``force``."""
    if not path_exists(spark, raw_root):
        return []
    todo = pending_files(files.raw_files(spark, raw_root), files.read_manifest(spark, case_root), force)
    years = sorted(r["ano"] for r in todo.select("ano").distinct().collect())       # supported years only
    return ingest_years(spark, {y: files.discover_year_file(spark, raw_root, y) for y in years}, case_root,
                        quality_root, **options)
