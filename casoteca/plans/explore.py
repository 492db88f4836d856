"""Queries over the exploratory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casoteca.operators import explore as E
from casoteca.plans.registry import query
from casoteca.plans.typed_sql import count_if, over_cases
from casoteca.sources.derived import raw_cases, stored_explored

STATE = "NATION_7"
CASES = "cast(count(*) AS bigint)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_KEPT = ["CASE_ID", "DT_SIN_PRI", "DT_NOTIFIC", "NU_IDADE_N", "CS_SEXO", "EVOLUCAO", "UTI"]


@query("legacy_clean", over_cases(
    "SELECT " + ", ".join(f"cast({n} AS string) AS {n}" if n.startswith("DT_") else n
                          for n in _KEPT) + " FROM explore"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.exploratory_clean(raw_cases(spark, sf)).select(*[
        F.col(n).cast("string").alias(n) if n.startswith("DT_") else n for n in _KEPT])


@query("legacy_uf_share", over_cases(f"""
    SELECT {count_if(f"upper(SG_UF) = '{STATE}'")} AS casos_uf, {CASES} AS casos_total,
      round_even({count_if(f"upper(SG_UF) = '{STATE}'")} / cast(count(*) AS double) * 100, 1)
        AS percentual FROM explore"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.state_share(stored_explored(spark, sf), STATE)


@query("monthly_dense_vs_uf", over_cases(f"""
    , counts AS (
      SELECT 'TOTAL' AS serie, last_day(DT_SIN_PRI) AS mes, count(*) AS n FROM explore
      WHERE DT_SIN_PRI IS NOT NULL GROUP BY ALL
      UNION ALL SELECT '{STATE}', last_day(DT_SIN_PRI), count(*) FROM explore
      WHERE DT_SIN_PRI IS NOT NULL AND upper(SG_UF) = '{STATE}' GROUP BY ALL),
    calendar AS (
      SELECT serie, last_day(unnest(generate_series(date_trunc('month', min(mes))::timestamp,
        date_trunc('month', max(mes))::timestamp, interval 1 month))::date) AS mes
      FROM counts GROUP BY serie)
    SELECT serie, cast(mes AS string) AS mes, cast(coalesce(n, 0) AS bigint) AS casos
    FROM calendar LEFT JOIN counts USING (serie, mes) ORDER BY serie, mes"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    series = E.monthly_dense(stored_explored(spark, sf), STATE)
    return series.withColumn("mes", F.col("mes").cast("string"))


@query("age_histogram", over_cases("""
    , span AS (SELECT min(NU_IDADE_N) AS lo, (max(NU_IDADE_N) - min(NU_IDADE_N)) / 30 AS w
               FROM explore),
    filled AS (SELECT least(cast(floor((NU_IDADE_N - lo) / w) AS bigint), 29) AS faixa,
                 count(*) AS n FROM explore, span WHERE NU_IDADE_N IS NOT NULL GROUP BY ALL)
    SELECT r.i AS faixa, round(lo + r.i * w, 6) AS inicio, round(lo + (r.i + 1) * w, 6) AS fim,
      cast(coalesce(n, 0) AS bigint) AS casos
    FROM range(30) r(i) CROSS JOIN span LEFT JOIN filled ON faixa = r.i ORDER BY faixa"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.age_histogram(stored_explored(spark, sf)), "inicio", "fim")


@query("age_density", over_cases("""
    , s AS (SELECT count(NU_IDADE_N) AS n, min(NU_IDADE_N) AS lo, max(NU_IDADE_N) AS hi,
              stddev_samp(NU_IDADE_N) * pow(count(NU_IDADE_N), -0.2) AS h FROM explore),
    v AS (SELECT NU_IDADE_N AS x, count(*) AS c FROM explore WHERE NU_IDADE_N IS NOT NULL
          GROUP BY ALL),
    g AS (SELECT i AS ponto, lo + i * (hi - lo) / 199 AS idade, n, lo, hi, h
          FROM range(200) r(i), s)
    SELECT cast(ponto AS int) AS ponto, round(idade, 6) AS idade,
      round(sum(c * exp(-0.5 * pow((idade - x) / h, 2)) / (sqrt(2 * pi()) * h)) / any_value(n), 6)
        AS densidade,
      round(sum(c * exp(-0.5 * pow((idade - x) / h, 2)) / (sqrt(2 * pi()) * h)) / any_value(n)
        * any_value(n) * (any_value(hi) - any_value(lo)) / 30, 4) AS frequencia
    FROM g, v GROUP BY ponto, idade ORDER BY ponto"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    density = _rounded(E.age_density(stored_explored(spark, sf)), "idade", "densidade")
    return density.withColumn("frequencia", F.round("frequencia", 4))


@query("cases_by_sex", over_cases(
    f"SELECT CS_SEXO AS sexo, {CASES} AS casos FROM explore WHERE CS_SEXO IS NOT NULL "
    "GROUP BY ALL ORDER BY casos DESC"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.cases_by_sex(stored_explored(spark, sf))


@query("cases_by_outcome", over_cases(f"""
    SELECT CASE EVOLUCAO WHEN 1 THEN 'Cura' WHEN 2 THEN 'Óbito' WHEN 3 THEN 'Óbito (outras causas)'
      WHEN 9 THEN 'Ignorado' END AS evolucao, {CASES} AS casos FROM explore
    WHERE EVOLUCAO IN (1, 2, 3, 9) GROUP BY ALL ORDER BY casos DESC"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.cases_by_outcome(stored_explored(spark, sf))


@query("legacy_icu_rate_by_band", over_cases("""
    SELECT CASE WHEN NU_IDADE_N <= 12 THEN '0-12' WHEN NU_IDADE_N <= 18 THEN '13-18'
      WHEN NU_IDADE_N <= 30 THEN '19-30' WHEN NU_IDADE_N <= 45 THEN '31-45'
      WHEN NU_IDADE_N <= 60 THEN '46-60' WHEN NU_IDADE_N <= 75 THEN '61-75' ELSE '76+' END
      AS faixa_etaria,
      round(avg(CASE WHEN UTI = 1 THEN 100.0::double ELSE 0 END), 6) AS taxa_uti
    FROM explore WHERE UTI IS NOT NULL AND NU_IDADE_N > 0 GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.icu_rate_by_band(stored_explored(spark, sf)), "taxa_uti")


@query("comorbidity_prevalence", over_cases("""
    SELECT comorbidade, round(p, 6) AS percentual FROM (
      SELECT unnest(['CARDIOPATI', 'DIABETES', 'OBESIDADE', 'ASMA']) AS comorbidade,
        unnest([count(*) FILTER (WHERE CARDIOPATI = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE DIABETES = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE OBESIDADE = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE ASMA = '1') * 100.0::double / count(*)]) AS p
      FROM explore) ORDER BY percentual"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.comorbidity_prevalence(stored_explored(spark, sf)), "percentual")


@query("top_municipalities", over_cases(f"""
    SELECT ID_MUNICIP AS municipio, {CASES} AS casos FROM explore WHERE ID_MUNICIP IS NOT NULL
    GROUP BY ALL ORDER BY casos DESC, municipio LIMIT 15"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_municipalities(stored_explored(spark, sf))


@query("cases_by_month", over_cases(f"""
    SELECT strftime(DT_SIN_PRI, '%Y-%m') AS ano_mes, {CASES} AS casos FROM explore
    WHERE DT_SIN_PRI IS NOT NULL GROUP BY ALL ORDER BY ano_mes"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.cases_by_month(stored_explored(spark, sf))


@query("cases_deaths_by_month", over_cases(f"""
    SELECT strftime(DT_SIN_PRI, '%Y-%m') AS ano_mes, {CASES} AS casos,
      {count_if("EVOLUCAO = 2")} AS obitos FROM explore
    WHERE DT_SIN_PRI IS NOT NULL GROUP BY ALL ORDER BY ano_mes"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.cases_deaths_by_month(stored_explored(spark, sf))


@query("obesity_icu_crosstab", over_cases("""
    SELECT CASE OBESIDADE WHEN '1' THEN 'Obeso' ELSE 'Não obeso' END AS obesidade,
      round_even(count(*) FILTER (WHERE UTI = 2) / cast(count(*) AS double) * 100, 2) AS uti_nao,
      round_even(count(*) FILTER (WHERE UTI = 1) / cast(count(*) AS double) * 100, 2) AS uti_sim
    FROM explore WHERE OBESIDADE IN ('1', '2') AND UTI IN (1, 2) GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.obesity_icu_crosstab(stored_explored(spark, sf))


# ---------------------------------------------------------------- one state

_HERE = f", here AS (SELECT * FROM explore WHERE upper(SG_UF) = '{STATE}')"


def _of_state(spark: SparkSession, sf: str) -> DataFrame:
    return E.filter_state(stored_explored(spark, sf), STATE)


@query("state_histogram", over_cases(_HERE + """
    , span AS (SELECT min(NU_IDADE_N) AS lo, (max(NU_IDADE_N) - min(NU_IDADE_N)) / 30 AS w FROM here),
    filled AS (SELECT least(cast(floor((NU_IDADE_N - lo) / w) AS bigint), 29) AS faixa,
                 count(*) AS n FROM here, span WHERE NU_IDADE_N IS NOT NULL GROUP BY ALL)
    SELECT r.i AS faixa, round(lo + r.i * w, 6) AS inicio, round(lo + (r.i + 1) * w, 6) AS fim,
      cast(coalesce(n, 0) AS bigint) AS casos
    FROM range(30) r(i) CROSS JOIN span LEFT JOIN filled ON faixa = r.i ORDER BY faixa"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.age_histogram(_of_state(spark, sf)), "inicio", "fim")


@query("state_prevalence", over_cases(_HERE + """
    SELECT comorbidade, round(p, 6) AS percentual FROM (
      SELECT unnest(['CARDIOPATI', 'DIABETES', 'OBESIDADE', 'ASMA']) AS comorbidade,
        unnest([count(*) FILTER (WHERE CARDIOPATI = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE DIABETES = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE OBESIDADE = '1') * 100.0::double / count(*),
                count(*) FILTER (WHERE ASMA = '1') * 100.0::double / count(*)]) AS p
      FROM here) ORDER BY percentual"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.comorbidity_prevalence(_of_state(spark, sf)), "percentual")


@query("state_top_municipalities", over_cases(_HERE + f"""
    SELECT ID_MUNICIP AS municipio, {CASES} AS casos FROM here WHERE ID_MUNICIP IS NOT NULL
    GROUP BY ALL ORDER BY casos DESC, municipio LIMIT 15"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_municipalities(_of_state(spark, sf))
