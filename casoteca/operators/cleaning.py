"""Cleaning of raw case records: names, spelling, duplicates and derived columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casoteca.functions import columns as C
from casoteca.functions import fixed


def normalize_column_names(df: DataFrame) -> DataFrame:
    names = [name.strip().upper() for name in df.columns]
    repeated = sorted(n for n, times in Counter(names).items() if times > 1)
    if repeated:
        raise ValueError("Colunas repetidas apos normalizacao: " + ", ".join(repeated))
    return df.toDF(*names)


def validate_required_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(fixed.REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError("Colunas essenciais ausentes: " + ", ".join(missing))
    return df


def validate_year(year: int) -> int:
    if year not in fixed.SUPPORTED_YEARS:
        raise ValueError(f"Ano nao suportado: {year}")
    return year


def canonical_codes(df: DataFrame) -> DataFrame:
    """One spelling per coded value, so that ``1`` and ``1.0`` make equal rows."""
    coded = set(fixed.CODED_COLUMNS)
    return df.select(*[C.canonical_code(F.col(n)).alias(n) if n in coded else F.col(n)
                       for n in df.columns])


def dedupe_cases(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Drop identical rows (NULL equals NULL); ``copies`` names a column for how many there were.

    The hash aggregate merges copies on the map side first, so a row repeated
    in a third of the table sends one row per task to the shuffle.
    """
    if copies is None:
        return df.dropDuplicates()
    return df.groupBy(*(F.col(f"`{n}`") for n in df.columns)).agg(F.count(F.lit(1)).alias(copies))


def _with_numbers(df: DataFrame, *names: str) -> DataFrame:
    """Parse each named column once, as ``__<name>``, for the expressions built on it."""
    return df.withColumns({f"__{n}": C.to_number(F.col(n)) for n in names})


def add_age(df: DataFrame) -> DataFrame:
    return (_with_numbers(df, "TP_IDADE", "NU_IDADE_N")
            .withColumn("IDADE_ANOS", C.age_in_years(F.col("__TP_IDADE"), F.col("__NU_IDADE_N")))
            .withColumn("FAIXA_ETARIA", C.age_band(F.col("IDADE_ANOS")))
            .drop("__TP_IDADE", "__NU_IDADE_N"))


def add_core_flags(df: DataFrame) -> DataFrame:
    return (_with_numbers(df, "EVOLUCAO", "UTI").withColumns({
        "DESFECHO_NORMALIZADO": C.outcome(F.col("__EVOLUCAO")),
        "FOI_UTI": C.yes_no(F.col("__UTI")),
        "OBITO_SRAG": F.coalesce(F.col("__EVOLUCAO") == 2, F.lit(False)),
    }).drop("__EVOLUCAO", "__UTI"))


def add_geography(df: DataFrame) -> DataFrame:
    code = C.to_whole(F.col("CO_MUN_RES")) if "CO_MUN_RES" in df.columns else F.lit(None)
    return df.withColumns({
        "UF": C.strip_upper(F.col("SG_UF")),
        "MUNICIPIO": C.strip_upper(F.col("ID_MUNICIP")),
        "CODIGO_MUNICIPIO": code.cast("bigint"),
    })


def add_calendar(df: DataFrame) -> DataFrame:
    """Onset date, its month, and the notified week; a missing week is never rebuilt."""
    onset = C.parse_date(F.col("DT_SIN_PRI")) if "DT_SIN_PRI" in df.columns else F.lit(None)
    week = C.to_whole(F.col("SEM_PRI"), "int") if "SEM_PRI" in df.columns else F.lit(None)
    return df.withColumns({
        "DATA_INICIO_SINTOMAS": onset.cast("date"),
        "SEMANA_EPIDEMIOLOGICA": week.cast("int"),
    }).withColumn("MES", F.month("DATA_INICIO_SINTOMAS"))


def add_etiology(df: DataFrame) -> DataFrame:
    labs = {n: F.col(n) for n in fixed.LAB_AGENTS if n in df.columns}
    classification = F.lit(fixed.ABSENT)
    if "CLASSI_FIN" in df.columns:
        df = _with_numbers(df, "CLASSI_FIN")
        classification = C.final_classification(F.col("__CLASSI_FIN"), F.col("CLASSI_FIN").isNotNull())
    return df.withColumns({
        "CLASSIFICACAO_FINAL_NORMALIZADA": classification,
        "ETIOLOGIA_DETALHADA": C.detailed_etiology(labs),
    }).drop("__CLASSI_FIN")


def add_derived_columns(df: DataFrame) -> DataFrame:
    """All derived columns; narrow, no shuffle."""
    return (df.transform(add_age).transform(add_core_flags).transform(add_geography)
              .transform(add_calendar).transform(add_etiology))


def clean_raw(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Normalised names, required columns checked, one spelling per code, no copies."""
    return (df.transform(normalize_column_names).transform(validate_required_columns)
              .transform(canonical_codes).transform(dedupe_cases, copies))


def transform_cases(df: DataFrame, year: int | None = None, copies: str | None = None) -> DataFrame:
    """Raw rows of one year to case rows; the only shuffle is the removal of copies.

    With ``year=None`` the frame must already carry an ``ANO`` column, which
    lets one plan clean many years that share their columns. ``copies`` names a
    column for the number of raw rows behind a case row.
    """
    if year is not None:
        validate_year(year)
    cases = df.transform(clean_raw, copies).transform(add_derived_columns)
    if year is not None:
        cases = cases.withColumn("ANO", F.lit(year).cast("int"))
    elif "ANO" not in cases.columns:
        raise ValueError("Informe o ano ou uma coluna ANO.")
    return cases


def total_comorbidities(df: DataFrame) -> DataFrame:
    """Number of whitelisted conditions answered "yes", over the columns that exist."""
    flags = [C.answered_yes(F.col(n)).cast("int")
             for n in fixed.COMORBIDITIES if n in df.columns]
    return df.withColumn("TOTAL_COMORBIDADES", sum(flags, F.lit(0)).cast("int"))


def add_region(df: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``REGIAO`` of ``UF``.

    Without ``regions`` the 27 Brazilian states are used, as one constant map
    in the projection. A ``regions`` frame (columns UF, REGIAO) is joined; the
    optimizer broadcasts it when its size allows.
    """
    if regions is not None:
        return df.join(regions.select("UF", "REGIAO"), "UF", "left")
    pairs = [F.lit(v) for kv in fixed.STATE_REGIONS.items() for v in kv]
    return df.withColumn("REGIAO", F.try_element_at(F.create_map(*pairs), F.col("UF")))


def add_onset_to_notification(df: DataFrame) -> DataFrame:
    """``SINT_ATE_NOTIF``: days from first symptoms to notification."""
    days = F.datediff(C.parse_date(F.col("DT_NOTIFIC")), F.col("DATA_INICIO_SINTOMAS"))
    return df.withColumn("SINT_ATE_NOTIF", days)


def add_codetection(df: DataFrame) -> DataFrame:
    """``AGENTES``: every positive agent in priority order; ``N_AGENTES``: how many."""
    hits = [F.when(C.answered_yes(F.col(n)), label)
            for n, label in fixed.LAB_AGENTS.items() if n in df.columns]
    agents = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return df.withColumn("AGENTES", agents).withColumn("N_AGENTES", F.size("AGENTES"))
