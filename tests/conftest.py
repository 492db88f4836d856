import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from casoteca.sources.session import SETTINGS  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (SparkSession.builder.master("local[8]").appName("casoteca-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def text_frame(spark):
    """Builds an all-text frame from dictionaries; missing keys are NULL."""
    def build(records):
        names = list(dict.fromkeys(k for r in records for k in r))
        schema = ", ".join(f"`{n}` string" for n in names)
        return spark.createDataFrame(
            [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records],
            schema)
    return build


@pytest.fixture(scope="session")
def five_cases(spark, text_frame):
    """Two cases of 2024 and three of 2025, as cleaned rows."""
    from casoteca.operators.cleaning import transform_cases
    from casoteca.sources.files import union_by_name

    def case(**given):
        return {"TP_IDADE": 3, "SG_UF": "PR", **given}

    curitiba = {"ID_MUNICIP": "CURITIBA", "CO_MUN_RES": 410690}
    londrina = {"ID_MUNICIP": "LONDRINA", "CO_MUN_RES": 411370}
    first = text_frame([
        case(**curitiba, NU_IDADE_N=70, EVOLUCAO=2, UTI=1, CS_SEXO="M", CLASSI_FIN=5,
             DT_SIN_PRI="10/01/2024", SEM_PRI=2, CARDIOPATI=1, DIABETES=2, OBESIDADE=9),
        case(**londrina, NU_IDADE_N=40, EVOLUCAO=1, UTI=2, CS_SEXO="F", PCR_FLUAS=1,
             DT_SIN_PRI="20/02/2024", SEM_PRI=8, CARDIOPATI=2, DIABETES=1, OBESIDADE=2),
    ])
    second = text_frame([
        case(**curitiba, NU_IDADE_N=67, EVOLUCAO=1, UTI=2, CS_SEXO="M", PCR_FLUAS=1,
             DT_SIN_PRI="15/03/2025", SEM_PRI=11, CARDIOPATI=1, DIABETES=1, OBESIDADE=2),
        case(**{**londrina, "TP_IDADE": 2}, NU_IDADE_N=18, EVOLUCAO=2, UTI=1, CS_SEXO="F",
             CLASSI_FIN=5, DT_SIN_PRI="02/04/2025", SEM_PRI=14, CARDIOPATI=2, DIABETES=2,
             OBESIDADE=1),
        case(**{"SG_UF": "MT"}, ID_MUNICIP="PRIMAVERA DO LESTE", CO_MUN_RES=510704, NU_IDADE_N=55,
             EVOLUCAO=9, UTI=9, CS_SEXO="M", PCR_VSR=1, DT_SIN_PRI="10/05/2025", SEM_PRI=19,
             CARDIOPATI=1, DIABETES=2, OBESIDADE=9),
    ])
    return union_by_name([transform_cases(first, 2024), transform_cases(second, 2025)]).cache()
