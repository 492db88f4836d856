"""Readers and writers: yearly CSV files, the year-partitioned case table, reports."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casoteca.functions import fixed
from casoteca.sources.session import wide_rows
from casoteca.sources.workspace import list_paths, path_exists


# ---------------------------------------------------------------- CSV

def missing_to_null(column: str) -> str:
    """SQL of a text column with every "no value" text turned into NULL."""
    name = "`" + column.replace("`", "``") + "`"
    tokens = ", ".join(f"'{t}'" for t in fixed.MISSING_TOKENS)
    return f"CASE WHEN {name} NOT IN ({tokens}) THEN {name} END AS {name}"


_ODD_LINE = "__linha"


def csv_scan(spark: SparkSession, path: str | list[str], *, sep: str = ";",
             encoding: str = "ISO-8859-1", multi_line: bool = False) -> DataFrame:
    """Delimited file with a header; all columns text, "no value" texts are NULL.

    ``multi_line`` allows line breaks inside quoted values, at the price of one
    task per file. Files of one scan must have the same header, and a line with
    more fields than it is an error; missing trailing fields are NULL.
    """
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
              .option("inferSchema", False).option("enforceSchema", False)
              .option("columnPruning", False))
    named = reader.csv(path).schema
    # lines whose number of fields differs from the header's are kept in a column of their own
    raw = reader.schema(T.StructType([*named, T.StructField(_ODD_LINE, T.StringType())])) \
        .option("columnNameOfCorruptRecord", _ODD_LINE).csv(path)
    bare = F.regexp_replace(_ODD_LINE, '"([^"]|"")*"', "")
    surplus = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= len(sep) * len(named)
    # Spark refuses to read the kept lines alone, so a named column is looked at too
    surplus &= F.coalesce(F.length(F.col(f"`{named.names[0]}`")), F.lit(0)) >= 0
    message = F.concat(F.lit("Linha com campos a mais: "), F.substring(_ODD_LINE, 1, 200))
    sound = F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(True)
    return raw.where(sound).selectExpr(*[missing_to_null(n) for n in named.names])


def write_csv(df: DataFrame, path: str, *, sep: str = ",", encoding: str = "UTF-8",
              mode: str = "errorifexists") -> None:
    """Delimited files with a header; blanks around values are kept as they are."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def reduce_columns(df: DataFrame, keep: Iterable[str] = fixed.REDUCED_COLUMNS) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[n for n in keep if n in df.columns])


def discover_year_file(spark: SparkSession, raw_root: str, year: int) -> str | None:
    """The single CSV file of ``raw_root/<year>/``; None without one, error with several."""
    found = list_paths(spark, f"{raw_root}/{year}/*.csv")
    if len(found) > 1:
        names = ", ".join(p.rsplit("/", 1)[-1] for p in found)
        raise ValueError(f"Mais de um CSV encontrado para {year}: {names}")
    return found[0] if found else None


_ENTRY = r"/(\d{4})/([^/]+\.csv)(/[^/]*)?$"


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length and modificationTime of files, from metadata only."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime"))


def _as_files(listing: DataFrame) -> DataFrame:
    """A row per year and file name; a folder named ``*.csv``, as Spark writes one, counts as one file."""
    return listing.groupBy("ano", "arquivo").agg(
        F.sum("length").alias("bytes"), F.max("modificationTime").alias("modificado"))


def raw_files(spark: SparkSession, raw_root: str) -> DataFrame:
    """ano, arquivo, bytes and modificado of the CSV files in the folders of supported years."""
    listing = _listed(spark, raw_root).where(F.col("path").rlike(r"\.csv$"))
    return _as_files(listing.select("*", F.regexp_extract("path", _ENTRY, 1).try_cast("int").alias("ano"),
                                    F.regexp_extract("path", _ENTRY, 2).alias("arquivo"))
                     .where(F.col("ano").isin(*fixed.SUPPORTED_YEARS)))


def input_files(spark: SparkSession, inputs: dict[int, str | list[str]]) -> DataFrame:
    """As ``raw_files``, for files that are named one by one; their metadata of now."""
    name = F.coalesce(F.regexp_extract("path", r"/([^/]+\.csv)(/[^/]*)?$", 1), F.lit(""))
    listed = [_listed(spark, path).where(~F.col("path").rlike(r"/[_.][^/]*$"))
              .select("*", F.lit(year).alias("ano"),
                      F.when(name != "", name).otherwise(F.regexp_extract("path", "([^/]+)$", 1)).alias("arquivo"))
              for year, path in inputs.items()]
    found = _as_files(reduce(DataFrame.unionByName, listed))
    return spark.createDataFrame(found.collect(), found.schema)      # a few rows per year, as they are now


def year_sources(spark: SparkSession, raw_root: str) -> DataFrame:
    """Number of CSV files in every year folder, from file metadata only."""
    return raw_files(spark, raw_root).groupBy("ano").agg(F.count(F.lit(1)).alias("arquivos"))


# ---------------------------------------------------------------- case table

def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Vertical union; a column a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_cases(cases: DataFrame, root: str, *, rebalance: bool = False) -> None:
    """Replace the touched years of the case table and leave the others alone.

    ``rebalance`` is for frames whose tasks mix years: it gathers each year and
    splits large years by size, so that files are neither tiny nor huge. A frame
    from the ingest jobs has one year per task and does without that shuffle.
    """
    if rebalance:
        cases = cases.hint("rebalance", "ANO")
    with wide_rows(cases.sparkSession):
        (cases.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ANO").parquet(root))


def stored_years(spark: SparkSession, root: str) -> list[int]:
    """Years present in the case table (at most one per supported year)."""
    return [y for y in fixed.SUPPORTED_YEARS if path_exists(spark, f"{root}/ANO={y}")]


#: The part of a file name that all files of one write job share.
_JOB = r"([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})"


def case_schema(spark: SparkSession, root: str) -> T.StructType:
    """Union of the schemas of all write jobs whose files are there, from one file footer per job.

    Files of one job share their columns and a part of their names, whatever years they belong to;
    a file named otherwise is looked at itself. One job reads the few footers; a column with different types in
    two of them is an error.
    """
    if path_exists(spark, root):
        stored = _listed(spark, root).where(F.col("path").rlike(r"/ANO=[^/]+/[^/_.][^/]*\.parquet$"))
        job = F.regexp_extract(F.regexp_extract("path", "([^/]+)$", 1), _JOB, 1)
        samples = stored.groupBy(F.when(job != "", job).otherwise(F.col("path"))).agg(F.min("path").alias("path"))
        paths = [r["path"] for r in samples.collect()]
        if paths:
            merged = spark.read.option("mergeSchema", True).parquet(*paths).schema
            return T.StructType([*(f for f in merged.fields if f.name != "ANO"), T.StructField("ANO", T.IntegerType())])
    raise FileNotFoundError(f"Nenhum Parquet de casos encontrado em {root}")


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """Case table of all years; ``ANO`` is the partition column, absent columns are NULL."""
    return spark.read.schema(case_schema(spark, root)).parquet(root)


def available_columns(df: DataFrame) -> list[str]:
    return sorted({n.upper() for n in df.columns})


def write_quality(report: DataFrame, root: str) -> None:
    """One JSON document per year; only the touched years are replaced."""
    (report.withColumn("particao", F.col("ano")).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("particao").json(root))


# ---------------------------------------------------------------- manifest

_MANIFEST = ("ano int, arquivo string, bytes bigint, modificado timestamp, registros_recebidos bigint, "
             "registros_processados bigint")


def write_manifest(entries: DataFrame, root: str) -> None:
    """What raw files the stored years were made of; only the touched years are replaced."""
    (entries.withColumn("particao", F.col("ano")).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("particao").parquet(f"{root}/_manifesto"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The raw files behind the stored years, empty before the first ingest."""
    path = f"{root}/_manifesto"
    if not path_exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(path)
