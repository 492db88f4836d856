"""SQL of the cleaned case table, the common first part of every check query."""

from __future__ import annotations

from casoteca.functions import fixed
from casoteca.sources.derived import RAW_CASES, TABLES

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
BLANKS = " \t\n\r "
DERIVED_TEXT = (
    "CASE_ID", "DT_SIN_PRI", "DT_NOTIFIC", "SEM_PRI", "TP_IDADE", "NU_IDADE_N", "SG_UF",
    "ID_MUNICIP", "CO_MUN_RES", "CS_SEXO", "EVOLUCAO", "UTI", "CLASSI_FIN", "PCR_SARS2",
    "PCR_FLUAS", "PCR_FLUBS", "PCR_VSR", "PCR_RINO", "CARDIOPATI", "DIABETES", "OBESIDADE",
    "ASMA", "DISPNEIA", "FEBRE",
)


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN try_cast({x} AS double) END"


def date(x: str) -> str:
    return f"try_strptime({x}, '%d/%m/%Y')::date"


def percent(numerator: str, denominator: str) -> str:
    return (f"round_even(CASE WHEN ({denominator}) > 0 THEN cast({numerator} AS double) / "
            f"({denominator}) * 100 END, 2)")


def count_if(condition: str) -> str:
    return f"cast(count(*) FILTER (WHERE {condition}) AS bigint)"


def _spelling(c: str) -> str:
    n = number(c)
    return (f"CASE WHEN {n} IS NULL THEN {c} WHEN ({n}) = floor({n}) "
            f"THEN cast(cast({n} AS bigint) AS string) ELSE cast({n} AS string) END AS {c}")


def _labels(n: str, labels: dict[int, str]) -> str:
    return " ".join(f"WHEN {n} = {code} THEN '{label}'" for code, label in labels.items())


def _bands() -> str:
    # written out, so that a wrong band in the package cannot match itself
    return ("WHEN IDADE_ANOS < 1 THEN '<1' WHEN IDADE_ANOS < 5 THEN '1-4' WHEN IDADE_ANOS < 12 THEN '5-11' "
            "WHEN IDADE_ANOS < 18 THEN '12-17' WHEN IDADE_ANOS < 30 THEN '18-29' "
            "WHEN IDADE_ANOS < 45 THEN '30-44' WHEN IDADE_ANOS < 60 THEN '45-59' "
            "WHEN IDADE_ANOS < 75 THEN '60-74' ELSE '75+'")


def _etiology() -> str:
    whens = " ".join(f"WHEN {c} = '1' THEN '{label}'" for c, label in fixed.LAB_AGENTS.items()
                     if c in DERIVED_TEXT)
    return f"CASE {whens} ELSE '{fixed.NO_AGENT}' END"


def _canonical() -> str:
    return ", ".join(_spelling(c) if c in fixed.CODED_COLUMNS else c for c in DERIVED_TEXT)


RAW = RAW_CASES.format(**{t: t for t in TABLES})

CASES = f"""{RAW},
canonical AS (SELECT DISTINCT ANO, {_canonical()} FROM raw),
numbers AS (
  SELECT *, {number('TP_IDADE')} AS n_unit, {number('NU_IDADE_N')} AS n_age,
         {number('EVOLUCAO')} AS n_outcome, {number('UTI')} AS n_icu,
         {number('CLASSI_FIN')} AS n_class, {number('CO_MUN_RES')} AS n_code,
         {number('SEM_PRI')} AS n_week
  FROM canonical),
aged AS (
  SELECT *, CASE WHEN n_age >= 0 AND years <= 120 THEN years END AS IDADE_ANOS
  FROM (SELECT *, CASE n_unit WHEN 1 THEN n_age / 365.25 WHEN 2 THEN n_age / 12.0
                              WHEN 3 THEN n_age END AS years FROM numbers)),
cases AS (
  SELECT * EXCLUDE (years),
    CASE WHEN IDADE_ANOS IS NULL THEN NULL {_bands()} END AS FAIXA_ETARIA,
    CASE WHEN n_outcome IS NULL THEN 'AUSENTE' {_labels('n_outcome', fixed.OUTCOME_LABELS)}
         ELSE 'OUTRO' END AS DESFECHO_NORMALIZADO,
    CASE WHEN n_icu IS NULL THEN 'AUSENTE' {_labels('n_icu', fixed.YES_NO_LABELS)}
         ELSE 'IGNORADO' END AS FOI_UTI,
    coalesce(n_outcome = 2, false) AS OBITO_SRAG,
    upper(trim(SG_UF, '{BLANKS}')) AS UF,
    upper(trim(ID_MUNICIP, '{BLANKS}')) AS MUNICIPIO,
    CASE WHEN n_code = floor(n_code) THEN cast(n_code AS bigint) END AS CODIGO_MUNICIPIO,
    {date('DT_SIN_PRI')} AS DATA_INICIO_SINTOMAS,
    cast(month({date('DT_SIN_PRI')}) AS int) AS MES,
    CASE WHEN n_week = floor(n_week) THEN cast(n_week AS int) END AS SEMANA_EPIDEMIOLOGICA,
    CASE WHEN CLASSI_FIN IS NULL THEN 'AUSENTE'
         {_labels('n_class', fixed.FINAL_CLASSIFICATION_LABELS)} ELSE 'OUTRO' END
      AS CLASSIFICACAO_FINAL_NORMALIZADA,
    {_etiology()} AS ETIOLOGIA_DETALHADA
  FROM aged),
explore AS (
  SELECT * REPLACE (
    {date('DT_SIN_PRI')} AS DT_SIN_PRI, {date('DT_NOTIFIC')} AS DT_NOTIFIC,
    CASE WHEN n_age BETWEEN 0 AND 120 THEN n_age END AS NU_IDADE_N,
    nullif(CS_SEXO, 'I') AS CS_SEXO, n_outcome AS EVOLUCAO, n_icu AS UTI)
  FROM (SELECT DISTINCT * FROM numbers))
"""


def over_raw(query: str) -> str:
    return f"WITH {RAW} {query}"


def over_cases(query: str) -> str:
    """``query`` may use ``raw``, ``cases`` and ``explore``; it may add its own tables."""
    return f"WITH {CASES} {query}"
