"""Per-year quality report of an ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casoteca.functions import columns as C
from casoteca.functions import fixed

_MISSING_COUNTS = {
    "idade_ausente": "IDADE_ANOS",
    "sexo_ausente": "CS_SEXO",
    "municipio_ausente": "ID_MUNICIP",
    "evolucao_ausente": "EVOLUCAO",
    "uti_ausente": "UTI",
}


def _missing(cases: DataFrame, name: str) -> Column:
    """Rows without a value; a column that does not exist is missing everywhere."""
    return F.count_if(F.col(name).isNull()) if name in cases.columns else F.count(F.lit(1))


def _processed(cases: DataFrame) -> dict[str, Column]:
    """What the report counts over case rows."""
    unidentified = (F.col("ETIOLOGIA_DETALHADA") == fixed.NO_AGENT
                  if "ETIOLOGIA_DETALHADA" in cases.columns else F.lit(False))
    return {"registros_processados": F.count(F.lit(1)),
            **{alias: _missing(cases, name) for alias, name in _MISSING_COUNTS.items()},
            "etiologia_nao_identificada": F.count_if(unidentified)}


def _as_report(counted: DataFrame) -> DataFrame:
    return counted.select(
        F.col("ANO").alias("ano"), "registros_recebidos", "registros_processados",
        (F.col("registros_recebidos") - F.col("registros_processados")).alias("duplicados"),
        *_MISSING_COUNTS, "etiologia_nao_identificada",
    )


def quality_report(raw: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per year, from one aggregate over each side.

    Both frames carry ``ANO``. Rows are removed from ``raw`` only as copies,
    so the copies are the difference of the two counts.
    """
    received = raw.groupBy("ANO").agg(F.count(F.lit(1)).alias("registros_recebidos"))
    processed = cases.groupBy("ANO").agg(*[c.alias(n) for n, c in _processed(cases).items()])
    joined = received.join(processed, "ANO", "left").na.fill(
        0, ["registros_processados", *_MISSING_COUNTS, "etiologia_nao_identificada"])
    return _as_report(joined)


def watched(cases: DataFrame, copies: str) -> tuple[DataFrame, Observation]:
    """The case rows, and the numbers of their report as seen by the job that writes them.

    ``copies`` is the column with the number of raw rows behind each row; so received rows are
    counted where the final tasks run, once a task, and not where a lost shuffle would be read anew.
    """
    seen = Observation()
    counts = {"registros_recebidos": F.coalesce(F.sum(copies), F.lit(0)), **_processed(cases)}
    return cases.observe(seen, *[c.alias(n) for n, c in counts.items()]).drop(copies), seen


def observed_report(spark: SparkSession, seen: dict[int, Observation]) -> DataFrame:
    """The report of written years, from what was observed: one row per year."""
    names = ["registros_recebidos", "registros_processados", *_MISSING_COUNTS, "etiologia_nao_identificada"]
    rows = [(year, *(int(o.get.get(n) or 0) for n in names)) for year, o in sorted(seen.items())]
    return _as_report(spark.createDataFrame(rows, "ANO int, " + ", ".join(f"{n} bigint" for n in names)))


def invalid_dates(cases: DataFrame, source: str = "DT_SIN_PRI") -> DataFrame:
    """Per year, how many filled dates of ``source`` are not a calendar date."""
    bad = F.col(source).isNotNull() & C.parse_date(F.col(source)).isNull()
    return cases.groupBy(F.col("ANO").alias("ano")).agg(F.count_if(bad).alias("datas_invalidas"))


def lab_conflicts(cases: DataFrame) -> DataFrame:
    """Per year, rows whose final class and positive test name different causes.

    Neither column is corrected. A class agrees with its own agents; "not
    specified" and "other agent" conflict with any positive test.
    """
    virus_class = {"SARS-CoV-2": "COVID-19", "Influenza A": "INFLUENZA", "Influenza B": "INFLUENZA"}
    agent, final = F.col("ETIOLOGIA_DETALHADA"), F.col("CLASSIFICACAO_FINAL_NORMALIZADA")
    expected = C.label_of(agent, virus_class)
    expected = F.coalesce(expected, F.when(agent != fixed.NO_AGENT, "OUTRO_VIRUS_RESPIRATORIO"))
    closed = final.isin(*fixed.FINAL_CLASSIFICATION_LABELS.values())
    return cases.groupBy(F.col("ANO").alias("ano")).agg(
        F.count_if(expected.isNotNull() & closed).alias("comparaveis"),
        F.count_if(expected.isNotNull() & closed & (final != expected)).alias("conflitos"),
    )
