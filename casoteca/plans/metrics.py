"""Queries over the case metrics. All read the stored, year-partitioned case table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casoteca.operators import cleaning
from casoteca.operators import metrics as M
from casoteca.operators.filters import Filters
from casoteca.plans.registry import query
from casoteca.plans.typed_sql import count_if, over_cases, percent
from casoteca.sources.derived import stored_cases

STATE = "NATION_7"

DEATHS = count_if("DESFECHO_NORMALIZADO = 'OBITO_SRAG'")
KNOWN = count_if("DESFECHO_NORMALIZADO IN ('CURA', 'OBITO_SRAG', 'OBITO_OUTRAS_CAUSAS')")
UNKNOWN = count_if("DESFECHO_NORMALIZADO IN ('IGNORADO', 'AUSENTE', 'OUTRO')")
ICU = count_if("FOI_UTI = 'SIM'")
ICU_KNOWN = count_if("FOI_UTI IN ('SIM', 'NAO')")
ICU_UNKNOWN = count_if("FOI_UTI IN ('IGNORADO', 'AUSENTE')")
CASES = "cast(count(*) AS bigint)"
BASE = (f"{CASES} AS casos, {DEATHS} AS obitos, {KNOWN} AS desfecho_conhecido, "
        f"{UNKNOWN} AS desfecho_desconhecido, {ICU} AS casos_uti, {ICU_KNOWN} AS uti_conhecida, "
        f"{ICU_UNKNOWN} AS uti_desconhecida")
FATALITY = (f"{percent(DEATHS, KNOWN)} AS valor, {DEATHS} AS numerador, "
            f"{KNOWN} AS denominador, {UNKNOWN} AS ignorados")
ICU_SHARE = (f"{percent(ICU, ICU_KNOWN)} AS valor, {ICU} AS numerador, "
             f"{ICU_KNOWN} AS denominador, {ICU_UNKNOWN} AS ignorados")


def _register(name: str, check: str | None, build, *args, **kwargs) -> None:
    query(name, check and over_cases(check))(
        lambda spark, sf: build(stored_cases(spark, sf), *args, **kwargs))


# ---------------------------------------------------------------- counts and ratios

_register("case_count", f"SELECT {CASES} AS valor FROM cases", M.case_count)
_register("base_counts", f"SELECT {BASE} FROM cases", M.base_counts)


@query("case_count_echo", over_cases(f"""
    SELECT {CASES} AS valor, '2024' AS ano_inicio, '{STATE}' AS uf, 'F' AS sexo,
      cast(3 AS bigint) AS restricoes
    FROM cases WHERE ANO >= 2024 AND UF = '{STATE}' AND CS_SEXO = 'F'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    counted = M.case_count_with_filters(stored_cases(spark, sf), Filters(ano_inicio=2024, uf=STATE, sexo="f"))
    return counted.select("valor", *(F.col("filtros")[n].alias(n) for n in ("ano_inicio", "uf", "sexo")),
                          F.size("filtros").cast("bigint").alias("restricoes"))


_register("mortality", f"SELECT {FATALITY} FROM cases", M.mortality)
_register("icu_proportion", f"SELECT {ICU_SHARE} FROM cases", M.icu_proportion)


@query("deaths_summary", over_cases(f"SELECT {DEATHS} AS obitos, {FATALITY} FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.deaths_summary(stored_cases(spark, sf)).select("obitos", "letalidade.*")


@query("icu_summary", over_cases(f"SELECT {ICU} AS casos_uti, {ICU_SHARE} FROM cases"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.icu_summary(stored_cases(spark, sf)).select("casos_uti", "proporcao_uti.*")


# ---------------------------------------------------------------- filters

_FILTERED = f"SELECT {BASE} FROM cases WHERE "
_register("filter_year_range", _FILTERED + "ANO >= 2022 AND ANO <= 2024", M.base_counts,
          Filters(ano_inicio=2022, ano_fim=2024))
_register("filter_geo",
          _FILTERED + f"UF = '{STATE}' AND MUNICIPIO = '{STATE} M3' AND CODIGO_MUNICIPIO = 7003",
          M.base_counts, Filters(uf=STATE, municipio=f" {STATE.lower()} m3", codigo_municipio=7003))
_register("filter_demog", _FILTERED + "CS_SEXO = 'F' AND FAIXA_ETARIA = '30-44'", M.base_counts,
          Filters(sexo=" f ", faixa_etaria="30-44"))
_register("filter_etiology", _FILTERED + "ETIOLOGIA_DETALHADA = 'Influenza A'", M.base_counts,
          Filters(etiologia="Influenza A"))

# ---------------------------------------------------------------- distributions

_register("age_distribution",
          f"SELECT FAIXA_ETARIA AS faixa_etaria, {CASES} AS casos FROM cases "
          "GROUP BY FAIXA_ETARIA ORDER BY min(IDADE_ANOS) NULLS LAST", M.age_distribution)
_register("etiology_distribution",
          f"SELECT ETIOLOGIA_DETALHADA AS etiologia, {CASES} AS casos FROM cases "
          "GROUP BY ALL ORDER BY casos DESC, etiologia", M.etiology_distribution)
_register("comorbidity_distribution", f"""
    SELECT comorbidade, casos FROM (
      SELECT 'CARDIOPATIA' AS comorbidade, {count_if("CARDIOPATI = '1'")} AS casos FROM cases
      UNION ALL SELECT 'DIABETES', {count_if("DIABETES = '1'")} FROM cases
      UNION ALL SELECT 'OBESIDADE', {count_if("OBESIDADE = '1'")} FROM cases
      UNION ALL SELECT 'ASMA', {count_if("ASMA = '1'")} FROM cases)
    WHERE casos > 0 ORDER BY casos DESC, comorbidade""", M.comorbidity_distribution)

# ---------------------------------------------------------------- series

_register("series_monthly",
          f"SELECT ANO AS ano, MES AS mes, {CASES} AS casos FROM cases "
          "WHERE MES IS NOT NULL GROUP BY ALL ORDER BY ano, mes", M.time_series)
_register("series_weekly",
          f"SELECT ANO AS ano, SEMANA_EPIDEMIOLOGICA AS semana_epidemiologica, {CASES} AS casos "
          "FROM cases WHERE SEMANA_EPIDEMIOLOGICA IS NOT NULL "
          "GROUP BY ALL ORDER BY ALL", M.time_series, Filters(), "semana")

# ---------------------------------------------------------------- rankings

_VALUES = {"cases": CASES, "deaths": DEATHS, "icu": ICU}
for _metric, _sql in _VALUES.items():
    _register(f"ranking_uf_{_metric}",
              f"SELECT UF AS uf, {_sql} AS valor FROM cases GROUP BY UF "
              "ORDER BY valor DESC, uf NULLS LAST LIMIT 20", M.ranking, metric=_metric)
    _register(f"ranking_mun_{_metric}",
              "SELECT UF AS uf, CODIGO_MUNICIPIO AS codigo_municipio, MUNICIPIO AS municipio, "
              f"{_sql} AS valor FROM cases GROUP BY ALL ORDER BY valor DESC, "
              "uf NULLS LAST, codigo_municipio NULLS LAST, municipio NULLS LAST LIMIT 50",
              M.ranking, Filters(), "municipio", _metric, 50)
_register("ranking_uf_fatality",
          f"SELECT UF AS uf, {percent(DEATHS, KNOWN)} AS valor FROM cases GROUP BY UF "
          "ORDER BY valor DESC NULLS LAST, uf NULLS LAST LIMIT 20", M.ranking, metric="fatality")
_register("ranking_uf_icu_prop",
          f"SELECT UF AS uf, {percent(ICU, ICU_KNOWN)} AS valor FROM cases GROUP BY UF "
          "ORDER BY valor DESC NULLS LAST, uf NULLS LAST LIMIT 20", M.ranking,
          metric="icu_proportion")

# ---------------------------------------------------------------- comparisons

_SLICE = """SELECT cast(count(*) AS bigint) AS c, {deaths} AS d, {ratio} AS l
    FROM cases WHERE {where}""".replace("{deaths}", DEATHS).replace(
        "{ratio}", percent(DEATHS, KNOWN))
_register("compare_slices", f"""
    , sa AS ({_SLICE.replace("{where}", f"UF = '{STATE}' AND ANO >= 2023")}),
    sb AS ({_SLICE.replace("{where}", "UF = 'NATION_11' AND CS_SEXO = 'M'")})
    SELECT a.c AS casos_a, a.d AS obitos_a, a.l AS letalidade_a, b.c AS casos_b, b.d AS obitos_b,
      b.l AS letalidade_b, a.c - b.c AS casos_absoluta, a.d - b.d AS obitos_absoluta,
      round_even(a.l - b.l, 2) AS letalidade_pontos_percentuais FROM sa a, sb b""",
          M.compare, Filters(uf=STATE, ano_inicio=2023), Filters(uf="NATION_11", sexo="M"))
_register("compare_many", f"""
    SELECT UF AS local, {CASES} AS casos, {DEATHS} AS obitos, {ICU} AS casos_uti,
      {percent(DEATHS, KNOWN)} AS letalidade, {percent(ICU, ICU_KNOWN)} AS proporcao_uti
    FROM cases WHERE UF IN ('NATION_7', 'NATION_11', 'NATION_19')
    GROUP BY UF ORDER BY local""", M.compare_many, ["NATION_7", "NATION_11", "NATION_19"])

# ---------------------------------------------------------------- co-detection


@query("codetection_counts", over_cases(f"""
    SELECT agentes, {CASES} AS casos FROM (
      SELECT concat_ws(' + ', CASE WHEN PCR_SARS2 = '1' THEN 'SARS-CoV-2' END,
          CASE WHEN PCR_FLUAS = '1' THEN 'Influenza A' END,
          CASE WHEN PCR_FLUBS = '1' THEN 'Influenza B' END,
          CASE WHEN PCR_VSR = '1' THEN 'VSR' END,
          CASE WHEN PCR_RINO = '1' THEN 'Rinovirus' END) AS agentes FROM cases)
    WHERE contains(agentes, ' + ') GROUP BY agentes"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.codetection_counts(cleaning.add_codetection(stored_cases(spark, sf)))
