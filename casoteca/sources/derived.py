"""Case records derived from the order tables, for trying every operator at any size.

The order tables hold no health records. One SQL text turns each order into a
raw case with everything a yearly file may contain: copies, missing and
malformed codes, impossible ages and dates, padded names, several agents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casoteca.operators.cleaning import transform_cases
from casoteca.operators.explore import exploratory_clean
from casoteca.sources.files import read_cases, write_cases
from casoteca.sources.session import wide_rows
from casoteca.sources.workspace import fingerprint, path_exists, shared_root

TABLES = ("orders", "customer", "nation")

RAW_CASES = """
b AS (
  SELECT o.o_orderkey AS k, cast(o.o_orderdate AS date) AS d, c.c_custkey AS ck, c.c_nationkey AS nk, n.n_name AS nn,
         (o.o_orderkey * 7) % 131 AS age, (o.o_orderkey * 7919) % 101 AS h1, (o.o_orderkey * 31) % 97 AS h2
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey),
r AS (
SELECT cast(k AS string) AS CASE_ID, cast(year(d) + 25 AS int) AS ANO,
  CASE WHEN k % 37 = 0 THEN NULL ELSE lpad(cast(day(d) AS string),2,'0')||'/'||lpad(cast(month(d) AS string),2,'0')||'/'||cast(year(d)+25 AS string) END AS DT_SIN_PRI,
  lpad(cast(day(d + cast(k % 15 AS int)) AS string),2,'0')||'/'||lpad(cast(month(d + cast(k % 15 AS int)) AS string),2,'0')||'/'||cast(year(d + cast(k % 15 AS int))+25 AS string) AS DT_NOTIFIC,
  CASE WHEN k % 41 = 0 THEN NULL ELSE cast(1 + cast(floor((dayofyear(d) - 1) / 7) AS int) AS string) END AS SEM_PRI,
  CASE k % 20 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '9' WHEN 3 THEN NULL ELSE '3' END AS TP_IDADE,
  CASE WHEN k % 53 = 0 THEN '-1' WHEN k % 59 = 0 THEN 'abc' ELSE cast(age AS string) END AS NU_IDADE_N,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 3 = 0 THEN ' '||lower(nn)||' ' ELSE nn END AS SG_UF,
  CASE WHEN ck % 67 = 0 THEN NULL ELSE nn||' m'||cast(ck % 20 AS string) END AS ID_MUNICIP,
  CASE WHEN k % 71 = 0 THEN 'X' WHEN k % 2 = 0 THEN cast(nk * 1000 + ck % 20 AS string)||'.0' ELSE cast(nk * 1000 + ck % 20 AS string) END AS CO_MUN_RES,
  CASE WHEN k % 43 = 0 THEN NULL WHEN k % 10 < 5 THEN 'M' WHEN k % 10 < 9 THEN 'F' ELSE 'I' END AS CS_SEXO,
  CASE WHEN 4 * h1 < 40 + age THEN '2' WHEN h1 < 80 THEN '1' WHEN h1 < 85 THEN '3' WHEN h1 < 92 THEN '9' WHEN h1 < 94 THEN '7' WHEN h1 < 96 THEN 'x' ELSE NULL END AS EVOLUCAO,
  CASE WHEN h2 < 25 THEN '1' WHEN h2 < 75 THEN '2' WHEN h2 < 88 THEN '9' WHEN h2 < 90 THEN '5' ELSE NULL END AS UTI,
  CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 5 THEN '5' WHEN 6 THEN '9' ELSE '4' END AS CLASSI_FIN,
  CASE k % 13 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE NULL END AS PCR_SARS2,
  CASE k % 17 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE NULL END AS PCR_FLUAS,
  CASE k % 19 WHEN 0 THEN '1' ELSE NULL END AS PCR_FLUBS,
  CASE k % 23 WHEN 0 THEN '1' ELSE NULL END AS PCR_VSR,
  CASE k % 29 WHEN 0 THEN '1' ELSE NULL END AS PCR_RINO,
  CASE k % 7 WHEN 0 THEN '1' WHEN 1 THEN '9' WHEN 2 THEN NULL ELSE '2' END AS CARDIOPATI,
  CASE k % 9 WHEN 0 THEN '1' WHEN 1 THEN '9' ELSE '2' END AS DIABETES,
  CASE k % 14 WHEN 0 THEN '1' WHEN 1 THEN '9' WHEN 2 THEN NULL ELSE '2' END AS OBESIDADE,
  CASE WHEN k % 31 = 0 THEN '1' ELSE '2' END AS ASMA,
  CASE WHEN h1 % 3 = 0 THEN '1' WHEN h1 % 3 = 1 THEN '2' ELSE '9' END AS DISPNEIA,
  CASE WHEN h2 % 5 < 3 THEN '1' ELSE '2' END AS FEBRE
FROM b),
raw AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE cast(CASE_ID AS bigint) % 50 = 7)
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, as a lazy plan over the whole order tables."""
    return spark.sql(f"WITH {RAW_CASES} SELECT * FROM raw", **tables(spark, sf_dir))


_written: set[str] = set()


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table in the shared folder, written the first time a session asks for it."""
    inputs = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])
    app = spark.sparkContext.applicationId
    root = f"{shared_root(spark)}/casoteca/{app}/{name}-{inputs}"
    if root not in _written or not path_exists(spark, root):
        write(root)
        _written.add(root)
    return root


def stored_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as a written table."""
    def write(root: str) -> None:
        with wide_rows(spark):
            raw_cases(spark, sf_dir).write.mode("overwrite").parquet(root)

    return spark.read.parquet(_once(spark, sf_dir, "raw", write))


def stored_explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after exploratory cleaning.

    Its removal of copies shuffles whole rows; written once, every table and
    model that follows reads only the columns it needs.
    """
    def write(root: str) -> None:
        with wide_rows(spark):
            exploratory_clean(raw_cases(spark, sf_dir)).write.mode("overwrite").parquet(root)

    return spark.read.parquet(_once(spark, sf_dir, "explored", write))


def stored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned, year-partitioned case table, as an ingest leaves it."""
    def write(root: str) -> None:
        write_cases(transform_cases(raw_cases(spark, sf_dir)), root, rebalance=True)

    return read_cases(spark, _once(spark, sf_dir, "cases", write))
