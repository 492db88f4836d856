"""Queries over the cleaning operators and the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casoteca.functions import fixed
from casoteca.ml.preprocess import unify_categorical_types
from casoteca.operators import cleaning, ingest, quality
from casoteca.plans.registry import query
from casoteca.plans.typed_sql import (DERIVED_TEXT, count_if, date, number, over_cases,
                                      over_raw)
from casoteca.sources import files
from casoteca.sources.derived import raw_cases, stored_cases, stored_raw, tables
from casoteca.sources.workspace import new_folder


def _write_year_files(raw: DataFrame, root: str) -> str:
    """Raw records as ``root/<year>/casos.csv``, one missing text per kind of gap."""
    for year in fixed.SUPPORTED_YEARS:
        part = raw.filter(F.col("ANO") == year).drop("ANO").na.fill("NaN", ["TP_IDADE", "UTI"])
        part = part.na.fill("NA", ["SG_UF", "EVOLUCAO"])
        if year <= 2022:
            part = part.drop("PCR_SARS2")
        files.write_csv(part, f"{root}/{year}/casos.csv", sep=";", encoding="ISO-8859-1")
    return root


# ---------------------------------------------------------------- cleaning

@query("normalize_columns", over_raw(
    "SELECT ANO, CASE_ID, SG_UF, EVOLUCAO FROM raw"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_cases(spark, sf).select("ANO", "CASE_ID", "SG_UF", "EVOLUCAO")
    untidy = raw.toDF(" ano", "case_id ", "Sg_Uf", " evolucao ")
    return cleaning.normalize_column_names(untidy)


@query("dedupe_cases", over_cases(
    "SELECT ANO, " + ", ".join(DERIVED_TEXT) + " FROM canonical"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_raw(raw_cases(spark, sf))


@query("age_normalized", over_cases(
    "SELECT CASE_ID, round(IDADE_ANOS, 6) AS IDADE_ANOS, FAIXA_ETARIA FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    aged = cleaning.add_age(cleaning.clean_raw(raw_cases(spark, sf)))
    return aged.select("CASE_ID", F.round("IDADE_ANOS", 6).alias("IDADE_ANOS"), "FAIXA_ETARIA")


@query("core_flags", over_cases(
    "SELECT CASE_ID, DESFECHO_NORMALIZADO, FOI_UTI, OBITO_SRAG FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_core_flags(cleaning.clean_raw(raw_cases(spark, sf))).select(
        "CASE_ID", "DESFECHO_NORMALIZADO", "FOI_UTI", "OBITO_SRAG")


@query("geography", over_cases("SELECT CASE_ID, UF, MUNICIPIO, CODIGO_MUNICIPIO FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_geography(cleaning.clean_raw(raw_cases(spark, sf))).select(
        "CASE_ID", "UF", "MUNICIPIO", "CODIGO_MUNICIPIO")


@query("temporal", over_cases(
    "SELECT CASE_ID, cast(DATA_INICIO_SINTOMAS AS string) AS DATA_INICIO_SINTOMAS, MES, "
    "SEMANA_EPIDEMIOLOGICA FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_calendar(cleaning.clean_raw(raw_cases(spark, sf))).select(
        "CASE_ID", F.col("DATA_INICIO_SINTOMAS").cast("string").alias("DATA_INICIO_SINTOMAS"),
        "MES", "SEMANA_EPIDEMIOLOGICA")


@query("etiology_columns", over_cases(
    "SELECT CASE_ID, CLASSIFICACAO_FINAL_NORMALIZADA, ETIOLOGIA_DETALHADA FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_etiology(cleaning.clean_raw(raw_cases(spark, sf))).select(
        "CASE_ID", "CLASSIFICACAO_FINAL_NORMALIZADA", "ETIOLOGIA_DETALHADA")


@query("transform_cases", over_cases(
    "SELECT * EXCLUDE (n_unit, n_age, n_outcome, n_icu, n_class, n_code, n_week) "
    "REPLACE (round(IDADE_ANOS, 6) AS IDADE_ANOS, "
    "cast(DATA_INICIO_SINTOMAS AS string) AS DATA_INICIO_SINTOMAS) FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.transform_cases(raw_cases(spark, sf)).withColumns({
        "IDADE_ANOS": F.round("IDADE_ANOS", 6),
        "DATA_INICIO_SINTOMAS": F.col("DATA_INICIO_SINTOMAS").cast("string")})


@query("unify_categorical_types", over_cases(f"""
    , share AS (SELECT count({number('UTI')}) * 1.0 / count(UTI) > 0.95 AS c_icu,
                       count({number('NU_IDADE_N')}) * 1.0 / count(NU_IDADE_N) > 0.95 AS c_age,
                       count({number('CS_SEXO')}) * 1.0 / count(CS_SEXO) > 0.95 AS c_sex FROM raw)
    SELECT CASE_ID,
      CASE WHEN c_icu THEN cast(cast({number('UTI')} AS bigint) AS string) ELSE UTI END AS UTI,
      CASE WHEN c_age THEN cast(cast({number('NU_IDADE_N')} AS bigint) AS string)
           ELSE NU_IDADE_N END AS NU_IDADE_N,
      CASE WHEN c_sex THEN cast(cast({number('CS_SEXO')} AS bigint) AS string)
           ELSE CS_SEXO END AS CS_SEXO
    FROM raw, share"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = ["UTI", "NU_IDADE_N", "CS_SEXO"]
    return unify_categorical_types(raw_cases(spark, sf).select("CASE_ID", *names), names)


# ---------------------------------------------------------------- optional features

@query("total_comorbidities", over_cases("""
    SELECT CASE_ID, cast((CARDIOPATI = '1')::int + (DIABETES = '1')::int
      + (OBESIDADE = '1')::int + (ASMA = '1')::int AS int) AS TOTAL_COMORBIDADES
    FROM (SELECT CASE_ID, coalesce(CARDIOPATI, '') AS CARDIOPATI,
                 coalesce(DIABETES, '') AS DIABETES, coalesce(OBESIDADE, '') AS OBESIDADE, coalesce(ASMA, '') AS ASMA FROM cases)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.total_comorbidities(stored_cases(spark, sf)).select(
        "CASE_ID", "TOTAL_COMORBIDADES")


@query("region_feature", over_cases("""
    SELECT c.CASE_ID, c.UF, r.r_name AS REGIAO FROM cases c
    LEFT JOIN nation n ON upper(n.n_name) = c.UF
    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    region = spark.read.parquet(f"{sf}/region.parquet")
    nation = tables(spark, sf)["nation"]
    regions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.upper("n_name").alias("UF"), F.col("r_name").alias("REGIAO"))
    return cleaning.add_region(stored_cases(spark, sf), regions).select("CASE_ID", "UF", "REGIAO")


@query("onset_to_notification", over_cases(f"""
    SELECT CASE_ID, cast(datediff('day', DATA_INICIO_SINTOMAS, {date('DT_NOTIFIC')}) AS int)
      AS SINT_ATE_NOTIF FROM cases"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_onset_to_notification(stored_cases(spark, sf)).select(
        "CASE_ID", "SINT_ATE_NOTIF")


@query("codetection", over_cases("""
    SELECT CASE_ID, AGENTES, N_AGENTES FROM (
      SELECT CASE_ID,
        concat_ws(' + ', CASE WHEN PCR_SARS2 = '1' THEN 'SARS-CoV-2' END,
          CASE WHEN PCR_FLUAS = '1' THEN 'Influenza A' END,
          CASE WHEN PCR_FLUBS = '1' THEN 'Influenza B' END,
          CASE WHEN PCR_VSR = '1' THEN 'VSR' END,
          CASE WHEN PCR_RINO = '1' THEN 'Rinovirus' END) AS AGENTES,
        cast(coalesce((PCR_SARS2 = '1')::int, 0) + coalesce((PCR_FLUAS = '1')::int, 0)
          + coalesce((PCR_FLUBS = '1')::int, 0) + coalesce((PCR_VSR = '1')::int, 0)
          + coalesce((PCR_RINO = '1')::int, 0) AS int) AS N_AGENTES
      FROM cases) WHERE N_AGENTES > 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = cleaning.add_codetection(stored_cases(spark, sf)).filter(F.col("N_AGENTES") > 1)
    return found.select("CASE_ID", F.array_join("AGENTES", " + ").alias("AGENTES"), "N_AGENTES")


# ---------------------------------------------------------------- files

@query("csv_scan", over_raw("SELECT cast(ANO AS string) AS ANO, " + ", ".join(DERIVED_TEXT)
                            + " FROM raw"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "csv")
    raw = raw_cases(spark, sf).na.fill("NaN", ["TP_IDADE"]).na.fill("<NA>", ["SG_UF", "UTI"])
    files.write_csv(raw, path, sep=";", encoding="ISO-8859-1")
    return files.csv_scan(spark, path)


@query("reduce_columns", over_raw(
    "SELECT " + ", ".join(c for c in fixed.REDUCED_COLUMNS if c in DERIVED_TEXT) + " FROM raw"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "reduced")
    files.write_csv(files.reduce_columns(raw_cases(spark, sf)), path, sep=";")
    return files.csv_scan(spark, path, encoding="UTF-8")


@query("year_sources", over_raw(
    "SELECT DISTINCT cast(ANO AS int) AS ano, cast(1 AS bigint) AS arquivos FROM raw"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "raw")
    raw = stored_raw(spark, sf).withColumn("year", F.col("ANO"))
    years = [y for y in fixed.SUPPORTED_YEARS if y != 2019]
    for year in years:
        files.write_csv(raw.filter(F.col("year") == year).drop("year"), f"{root}/{year}/casos.csv")
    return files.year_sources(spark, root)


@query("incremental_years", over_cases("""
    SELECT ANO AS ano, cast(count(*) AS bigint) AS casos,
      CASE WHEN ANO = 2021 OR ANO > 2022 THEN 2 ELSE 1 END AS vez
    FROM cases WHERE ANO <> 2021 OR SG_UF IS NOT NULL GROUP BY ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingests; before the second one a file has changed and later years have come."""
    root = new_folder(spark, "incremental")
    raw = stored_raw(spark, sf)
    runs = []
    for rows in (raw.filter("ANO <= 2022"), raw.filter("ANO = 2021 AND SG_UF IS NOT NULL OR ANO > 2022")):
        for (year,) in rows.select("ANO").distinct().collect():     # supported years
            files.write_csv(rows.filter(F.col("ANO") == year).drop("ANO"), f"{root}/raw/{year}/casos.csv", sep=";",
                            encoding="ISO-8859-1", mode="overwrite")
        runs.append(ingest.ingest_all(spark, f"{root}/raw", f"{root}/cases", f"{root}/quality"))
    second = F.when(F.col("ANO").isin(runs[1]), 2).otherwise(1)
    return files.read_cases(spark, f"{root}/cases").groupBy(F.col("ANO").alias("ano")).agg(
        F.count(F.lit(1)).alias("casos"), F.max(second).alias("vez"))


@query("parquet_roundtrip", over_cases("""
    SELECT ANO, cast(count(*) AS bigint) AS casos, cast(count(UF) AS bigint) AS com_uf
    FROM cases WHERE ANO <> 2025 OR UF IS NOT NULL GROUP BY ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "roundtrip")
    cases = stored_cases(spark, sf)
    files.write_cases(cases, root)
    files.write_cases(cases.filter("ANO = 2025 AND UF IS NOT NULL"), root)
    return files.read_cases(spark, root).groupBy("ANO").agg(
        F.count(F.lit(1)).alias("casos"), F.count("UF").alias("com_uf"))


@query("scan_union_by_name", over_cases(f"""
    SELECT ANO, cast(count(*) AS bigint) AS casos,
      {count_if("PCR_SARS2 IS NOT NULL AND ANO > 2022")} AS com_pcr FROM cases GROUP BY ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "drift")
    cases = stored_cases(spark, sf)
    files.write_cases(cases.filter("ANO <= 2022").drop("PCR_SARS2"), root)
    files.write_cases(cases.filter("ANO > 2022"), root)
    return files.read_cases(spark, root).groupBy("ANO").agg(
        F.count(F.lit(1)).alias("casos"), F.count("PCR_SARS2").alias("com_pcr"))


@query("available_columns")
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = files.available_columns(stored_cases(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "coluna string")


_INGESTED = """
    SELECT ANO, cast(count(*) AS bigint) AS casos, {deaths} AS obitos, {flu} AS influenza_a,
      cast(count(UF) AS bigint) AS com_uf, cast(count(MES) AS bigint) AS com_mes
    FROM cases {where} GROUP BY ANO""".replace(
        "{deaths}", count_if("DESFECHO_NORMALIZADO = 'OBITO_SRAG'")).replace(
        "{flu}", count_if("PCR_FLUAS = '1' AND (ANO <= 2022 OR coalesce(PCR_SARS2, '2') <> '1')"))


def _ingest_summary(spark: SparkSession, root: str) -> DataFrame:
    return files.read_cases(spark, root).groupBy("ANO").agg(
        F.count(F.lit(1)).alias("casos"), F.count_if("OBITO_SRAG").alias("obitos"),
        F.count_if(F.col("ETIOLOGIA_DETALHADA") == "Influenza A").alias("influenza_a"),
        F.count("UF").alias("com_uf"), F.count("MES").alias("com_mes"))


@query("ingest_year", over_cases(_INGESTED.replace("{where}", "WHERE ANO = 2024")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "ingest-year")
    raw = stored_raw(spark, sf).filter("ANO = 2024").drop("ANO")
    path = f"{root}/raw/2024/casos.csv"
    files.write_csv(raw, path, sep=";", encoding="ISO-8859-1")
    ingest.ingest_year(spark, path, f"{root}/cases", f"{root}/quality", 2024)
    return _ingest_summary(spark, f"{root}/cases")


@query("ingest_all_years", over_cases(_INGESTED.replace("{where}", "")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "ingest-all")
    raw_root = _write_year_files(stored_raw(spark, sf), f"{root}/raw")
    ingest.ingest_all(spark, raw_root, f"{root}/cases", f"{root}/quality")
    return _ingest_summary(spark, f"{root}/cases")


# ---------------------------------------------------------------- quality

@query("quality_report", over_cases(f"""
    , received AS (SELECT ANO, cast(count(*) AS bigint) AS n FROM raw GROUP BY ANO)
    SELECT c.ANO AS ano, any_value(r.n) AS registros_recebidos,
      cast(count(*) AS bigint) AS registros_processados,
      cast(any_value(r.n) - count(*) AS bigint) AS duplicados,
      {count_if("IDADE_ANOS IS NULL")} AS idade_ausente,
      {count_if("CS_SEXO IS NULL")} AS sexo_ausente,
      {count_if("ID_MUNICIP IS NULL")} AS municipio_ausente,
      {count_if("EVOLUCAO IS NULL")} AS evolucao_ausente,
      {count_if("UTI IS NULL")} AS uti_ausente,
      {count_if("ETIOLOGIA_DETALHADA = 'NAO_IDENTIFICADA'")} AS etiologia_nao_identificada
    FROM cases c JOIN received r ON r.ANO = c.ANO GROUP BY c.ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(raw_cases(spark, sf), stored_cases(spark, sf))


@query("quality_invalid_dates", over_cases(f"""
    SELECT ANO AS ano, {count_if("DT_SIN_PRI IS NOT NULL AND DATA_INICIO_SINTOMAS IS NULL")}
      AS datas_invalidas FROM cases GROUP BY ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invalid_dates(stored_cases(spark, sf))


_EXPECTED = """CASE ETIOLOGIA_DETALHADA WHEN 'SARS-CoV-2' THEN 'COVID-19'
    WHEN 'Influenza A' THEN 'INFLUENZA' WHEN 'Influenza B' THEN 'INFLUENZA'
    WHEN 'NAO_IDENTIFICADA' THEN NULL ELSE 'OUTRO_VIRUS_RESPIRATORIO' END"""
_CLOSED = "CLASSIFICACAO_FINAL_NORMALIZADA NOT IN ('AUSENTE', 'OUTRO')"


@query("lab_conflicts", over_cases(f"""
    SELECT ANO AS ano, {count_if(f"{_EXPECTED} IS NOT NULL AND {_CLOSED}")} AS comparaveis,
      {count_if(f"{_EXPECTED} <> CLASSIFICACAO_FINAL_NORMALIZADA AND {_CLOSED}")} AS conflitos
    FROM cases GROUP BY ANO"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.lab_conflicts(stored_cases(spark, sf))
