import datetime

import pytest
from pyspark.sql import functions as F

from casoteca.functions import columns as C
from casoteca.operators import cleaning
from conftest import rows

BASE = {"TP_IDADE": 3, "NU_IDADE_N": 40, "SG_UF": "PR", "ID_MUNICIP": "CURITIBA", "EVOLUCAO": 1,
        "UTI": 2}


def one(df, *names):
    return tuple(df.select(*names).first())


@pytest.mark.parametrize("text,number", [
    ("1", 1.0), ("1.0", 1.0), (" 2 ", 2.0), ("-1", -1.0), ("1e2", 100.0), (".5", 0.5),
    ("NaN", None), ("1d", None), ("abc", None), ("", None), (None, None), ("0x10", None),
    ("1\t", 1.0), ("\u00a01", 1.0), ("2\u2003", 2.0),
])
def test_to_number(text_frame, text, number):
    assert one(text_frame([{"a": text, "b": 1}]), C.to_number(F.col("a"))) == (number,)


@pytest.mark.parametrize("text,code", [
    ("1.0", "1"), ("01", "1"), (" 1", "1"), ("0", "0"), ("1.50", "1.5"), ("100", "100"),
    ("-1.0", "-1"), ("X", "X"), ("4106902.0", "4106902"), (None, None),
    ("1\t", "1"), ("1\u00a0", "1"), ("\u00a001", "1"), ("9\x1f", "9"), ("\u00c1GUA", "\u00c1GUA"),
])
def test_canonical_code(text_frame, text, code):
    assert one(text_frame([{"a": text, "b": 1}]), C.canonical_code(F.col("a"))) == (code,)


@pytest.mark.parametrize("unit,value,years,band", [
    (1, 10, 10 / 365.25, "<1"), (2, 18, 1.5, "1-4"), (3, 0, 0.0, "<1"), (3, 5, 5.0, "5-11"),
    (3, 75, 75.0, "75+"), (3, 120, 120.0, "75+"), (3, 121, None, None), (3, -1, None, None),
    (4, 10, None, None), (None, 10, None, None), (3, "abc", None, None), (3, "NaN", None, None),
])
def test_age(text_frame, unit, value, years, band):
    df = cleaning.add_age(text_frame([{"TP_IDADE": unit, "NU_IDADE_N": value, "k": 1}]))
    got_years, got_band = one(df, "IDADE_ANOS", "FAIXA_ETARIA")
    assert got_years == pytest.approx(years) and got_band == band


@pytest.mark.parametrize("code,outcome,icu,death", [
    (1, "CURA", "SIM", False), (2, "OBITO_SRAG", "NAO", True),
    (3, "OBITO_OUTRAS_CAUSAS", "IGNORADO", False), (9, "IGNORADO", "IGNORADO", False),
    (7, "OUTRO", "IGNORADO", False), (None, "AUSENTE", "AUSENTE", False),
    ("x", "AUSENTE", "AUSENTE", False),
])
def test_core_flags(text_frame, code, outcome, icu, death):
    df = cleaning.add_core_flags(text_frame([{"EVOLUCAO": code, "UTI": code, "k": 1}]))
    assert one(df, "DESFECHO_NORMALIZADO", "FOI_UTI", "OBITO_SRAG") == (outcome, icu, death)


@pytest.mark.parametrize("code,label", [
    (1, "INFLUENZA"), (2, "OUTRO_VIRUS_RESPIRATORIO"), (3, "OUTRO_AGENTE_ETIOLOGICO"),
    (4, "NAO_ESPECIFICADO"), (5, "COVID-19"), (9, "OUTRO"), ("x", "OUTRO"), (None, "AUSENTE"),
])
def test_final_classification(text_frame, code, label):
    df = cleaning.add_etiology(text_frame([{"CLASSI_FIN": code, "k": 1}]))
    assert one(df, "CLASSIFICACAO_FINAL_NORMALIZADA") == (label,)


def test_first_positive_test_names_the_agent(text_frame):
    df = cleaning.add_etiology(text_frame([
        {"k": 1, "CLASSI_FIN": 4, "PCR_SARS2": 1, "PCR_VSR": 1},
        {"k": 2, "PCR_SARS2": 2, "PCR_VSR": "1.0"}, {"k": 3, "PCR_SARS2": 9}]))
    got = rows(df.select("k", "ETIOLOGIA_DETALHADA", "CLASSIFICACAO_FINAL_NORMALIZADA"))
    assert sorted(got) == [("1", "SARS-CoV-2", "NAO_ESPECIFICADO"), ("2", "VSR", "AUSENTE"),
                           ("3", "NAO_IDENTIFICADA", "AUSENTE")]


def test_absent_columns_give_absent_values(text_frame):
    df = cleaning.transform_cases(text_frame([BASE]), 2019)
    assert one(df, "CODIGO_MUNICIPIO", "DATA_INICIO_SINTOMAS", "MES", "SEMANA_EPIDEMIOLOGICA",
               "CLASSIFICACAO_FINAL_NORMALIZADA", "ETIOLOGIA_DETALHADA", "ANO") == (
        None, None, None, None, "AUSENTE", "NAO_IDENTIFICADA", 2019)


def test_names_are_trimmed_of_every_blank(text_frame):
    df = cleaning.add_geography(text_frame([{"SG_UF": "  pr\t", "ID_MUNICIP": " são joão "}]))
    assert one(df, "UF", "MUNICIPIO") == ("PR", "SÃO JOÃO")


@pytest.mark.parametrize("code,number", [("410690", 410690), ("410690.0", 410690), ("X", None),
                                         ("1.5", None), (None, None)])
def test_municipality_code(text_frame, code, number):
    df = cleaning.add_geography(text_frame([{"SG_UF": "PR", "ID_MUNICIP": "A", "CO_MUN_RES": code}]))
    assert one(df, "CODIGO_MUNICIPIO") == (number,)


@pytest.mark.parametrize("text,date", [
    ("3-4-2025", (2025, 4, 3)), ("3/4/25", (2025, 4, 3)), ("29-02-72", (1972, 2, 29)),
    ("3/4-2025", None), ("3/4/025", None), ("03/04/2025\u00a0", (2025, 4, 3)),
    ("03/04/2025", (2025, 4, 3)), ("3/4/2025", (2025, 4, 3)), ("2025-03-04", (2025, 3, 4)),
    ("2025-03-04T00:00:00", (2025, 3, 4)), ("29/02/2023", None), ("31/13/2025", None),
    ("abc", None), (None, None),
])
def test_dates_are_day_first_then_iso(text_frame, text, date):
    df = cleaning.add_calendar(text_frame([{"DT_SIN_PRI": text, "SEM_PRI": "x", "k": 1}]))
    want = datetime.date(*date) if date else None
    assert one(df, "DATA_INICIO_SINTOMAS", "MES", "SEMANA_EPIDEMIOLOGICA") == (
        want, want.month if want else None, None)


def test_copies_differ_only_in_spelling(text_frame):
    df = text_frame([BASE, {**BASE, "UTI": "2.0"}, {**BASE, "UTI": "1"}, {**BASE, "UTI": None},
                     {**BASE, "UTI": None}])
    assert cleaning.clean_raw(df).count() == 3


def test_raw_columns_pass_through(text_frame):
    df = cleaning.transform_cases(text_frame([{**BASE, "extra ": "a"}]), 2024)
    assert one(df, "EXTRA", "EVOLUCAO") == ("a", "1")


def test_errors(text_frame):
    df = text_frame([BASE])
    with pytest.raises(ValueError, match="ausentes: EVOLUCAO, UTI"):
        cleaning.transform_cases(df.drop("UTI", "EVOLUCAO"), 2024)
    with pytest.raises(ValueError, match="2018"):
        cleaning.transform_cases(df, 2018)
    with pytest.raises(ValueError, match="repetidas"):
        cleaning.normalize_column_names(df.selectExpr("UTI", "UTI AS ` uti`"))


def test_optional_features(text_frame):
    df = cleaning.transform_cases(text_frame([
        {**BASE, "ASMA": 1, "RENAL": 1, "PCR_VSR": 1, "PCR_RINO": 1, "DT_SIN_PRI": "01/03/2024",
         "DT_NOTIFIC": "05/03/2024"}]), 2024)
    df = df.transform(cleaning.total_comorbidities).transform(cleaning.add_region)
    df = df.transform(cleaning.add_onset_to_notification).transform(cleaning.add_codetection)
    assert one(df, "TOTAL_COMORBIDADES", "REGIAO", "SINT_ATE_NOTIF", "AGENTES") == (
        2, "SUL", 4, ["VSR", "Rinovirus"])


def test_classification_is_parsed_once_a_row(spark):
    """Every label compares the number; the text behind it is read in a projection of its own."""
    cases = cleaning.add_etiology(spark.range(5).select(F.col("id").cast("string").alias("CLASSI_FIN")))
    plan = cases._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2 and "__CLASSI_FIN" not in cases.columns


@pytest.mark.parametrize("text, number, whole", [
    ("5", 5.0, 5), ("-07", -7.0, -7), (" 5\n", 5.0, 5), ("5\n", 5.0, 5), ("5\u2028", 5.0, 5), ("5.50", 5.5, None),
    ("5.0", 5.0, 5), ("-0", 0.0, 0), ("", None, None), ("5x", None, None), ("-", None, None), ("\u0665", None, None),
    ("9" * 25, 1e25, None), ("0" * 25 + "1", 1.0, 1), (None, None, None)])
def test_plain_digits_and_other_spellings(text_frame, text, number, whole):
    row = text_frame([{"c": text, "d": "x"}]).select(
        C.to_number(F.col("c")).alias("n"), C.to_whole(F.col("c")).alias("w")).first()
    assert (row["n"], row["w"]) == (number, whole)
