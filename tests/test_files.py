import json

import pytest
from pyspark.sql import functions as F

from casoteca.functions import fixed
from casoteca.operators import ingest, metrics
from casoteca.operators.quality import quality_report
from casoteca.sources import files
from conftest import rows

HEADER = ["TP_IDADE", "NU_IDADE_N", "SG_UF", "ID_MUNICIP", "CO_MUN_RES", "EVOLUCAO", "UTI"]


def write(path, lines, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join([";".join(header), *lines]) + "\n"
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_missing_texts_and_encoding(spark, tmp_path):
    lines = [f"{i};{token};a" for i, token in enumerate(t for t in fixed.MISSING_TOKENS if t)]
    path = write(tmp_path / "a.csv", [*lines, '98;"";São', "99;none;x"], ["k", "v", "w"])
    df = files.csv_scan(spark, path)
    assert rows(df.filter("v IS NOT NULL")) == [("99", "none", "x")]
    assert rows(df.filter("k = 98")) == [("98", None, "São")]


def test_year_discovery(spark, tmp_path):
    write(tmp_path / "2024" / "a.csv", [])
    assert files.discover_year_file(spark, str(tmp_path), 2024).endswith("2024/a.csv")
    assert files.discover_year_file(spark, str(tmp_path), 2023) is None
    write(tmp_path / "2024" / "b.csv", [])
    with pytest.raises(ValueError, match="a.csv, b.csv"):
        files.discover_year_file(spark, str(tmp_path), 2024)
    assert rows(files.year_sources(spark, str(tmp_path))) == [(2024, 2)]


def test_ingest_is_incremental(spark, tmp_path):
    raw, cases, report = (str(tmp_path / n) for n in ("raw", "cases", "quality"))
    write(tmp_path / "raw/2024/a.csv", ["3;40;pr;CURITIBA;1;1;2", "3;40;pr;CURITIBA;1.0;1;2"])
    write(tmp_path / "raw/2025/a.csv", ["3;50;MT;X;2;2;1;1"], [*HEADER, "PCR_VSR"])
    assert ingest.ingest_all(spark, raw, cases, report) == [2024, 2025]
    assert ingest.ingest_all(spark, raw, cases, report) == []
    with pytest.raises(FileExistsError, match="2024"):
        ingest.ingest_year(spark, f"{raw}/2024/a.csv", cases, report, 2024)
    write(tmp_path / "raw/2024/a.csv", ["3;41;PR;LONDRINA;1;1;2"])
    ingest.ingest_year(spark, f"{raw}/2024/a.csv", cases, report, 2024, force=True)
    table = files.read_cases(spark, cases)
    assert sorted(rows(table.select("ANO", "UF", "MUNICIPIO", "ETIOLOGIA_DETALHADA"))) == [
        (2024, "PR", "LONDRINA", "NAO_IDENTIFICADA"), (2025, "MT", "X", "VSR")]
    saved = [json.loads(line) for p in (tmp_path / "quality").rglob("*.json")
             for line in p.read_text().splitlines()]
    assert {d["ano"]: d["duplicados"] for d in saved} == {2024: 0, 2025: 0}
    assert files.stored_years(spark, cases) == [2024, 2025]


def test_no_case_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_cases(spark, str(tmp_path / "none"))


def test_changed_files_are_ingested_again(spark, tmp_path):
    raw, cases, report = (str(tmp_path / n) for n in ("raw", "cases", "quality"))
    assert ingest.ingest_all(spark, raw, cases, report) == []
    write(tmp_path / "raw/2024/a.csv", ["3;40;pr;CURITIBA;1;1;2"] * 3)
    write(tmp_path / "raw/2025/a.csv", [])
    assert ingest.ingest_all(spark, raw, cases, report) == [2024, 2025]
    kept = {r.ano: r for r in files.read_manifest(spark, cases).collect()}
    assert (kept[2024].registros_recebidos, kept[2024].registros_processados) == (3, 1)
    assert (kept[2025].registros_recebidos, kept[2025].registros_processados) == (0, 0)
    assert kept[2024].bytes == (tmp_path / "raw/2024/a.csv").stat().st_size
    assert ingest.ingest_all(spark, raw, cases, report) == []
    write(tmp_path / "raw/2025/a.csv", ["3;50;MT;X;2;2;1"])
    assert ingest.ingest_all(spark, raw, cases, report) == [2025]
    assert ingest.ingest_all(spark, raw, cases, report, force=True) == [2024, 2025]
    assert sorted(r.ANO for r in files.read_cases(spark, cases).collect()) == [2024, 2025]


def test_raw_files_are_read_once(spark, tmp_path):
    """One job for write, report and manifest: no later job looks at the raw files."""
    raw, cases, report = (str(tmp_path / n) for n in ("raw", "cases", "quality"))
    path = write(tmp_path / "raw/2024/a.csv", ["3;40;pr;CURITIBA;1;1;2"] * 5 + ["3;41;pr;CURITIBA;1;;2"])
    reads = []
    real = files.csv_scan

    def scan(*args, **named):
        looked = spark.sparkContext.accumulator(0)
        reads.append(looked)

        def seen(batches):
            for batch in batches:
                looked.add(batch.num_rows)
                yield batch

        df = real(*args, **named)
        return df.mapInArrow(seen, df.schema)

    try:
        files.csv_scan = scan
        ingest.ingest_year(spark, path, cases, report, 2024)
    finally:
        files.csv_scan = real
    assert [r.value for r in reads] == [6]
    saved = [json.loads(line) for p in (tmp_path / "quality").rglob("*.json") for line in p.read_text().splitlines()]
    assert [(d["registros_recebidos"], d["registros_processados"], d["duplicados"], d["evolucao_ausente"])
            for d in saved] == [(6, 2, 4, 1)]


def test_schema_of_every_write(spark, tmp_path, five_cases):
    """Two files of a year with different columns, and a year no ingest would take, keep all their columns."""
    root = str(tmp_path / "cases")
    year = five_cases.filter("ANO = 2025")
    year.withColumn("A_MAIS", F.lit("x")).write.partitionBy("ANO").parquet(root)
    year.drop("PCR_VSR").withColumn("OUTRA", F.lit(1)).write.mode("append").partitionBy("ANO").parquet(root)
    year.select("EVOLUCAO", F.lit(1999).alias("ANO"), F.lit("y").alias("ANTIGA")).write.mode("append") \
        .partitionBy("ANO").parquet(root)
    table = files.read_cases(spark, root)
    assert {"A_MAIS", "OUTRA", "ANTIGA", "PCR_VSR"} <= set(table.columns)
    assert table.columns.count("ANO") == 1
    counts = table.agg(F.count("A_MAIS"), F.count("OUTRA"), F.count("ANTIGA"), F.count("*")).first()
    assert tuple(counts) == (3, 3, 3, 9)
    files.write_cases(year.drop("PCR_VSR"), root)
    assert "A_MAIS" not in files.read_cases(spark, root).columns


def test_quality_report(text_frame):
    base = {"TP_IDADE": 3, "NU_IDADE_N": 70, "SG_UF": "PR", "ID_MUNICIP": "CURITIBA",
            "EVOLUCAO": 2, "UTI": 1, "PCR_SARS2": 1}
    raw = text_frame([base, base, {"TP_IDADE": 3, "EVOLUCAO": 9}])
    raw = raw.withColumn("ANO", F.lit(2025))
    from casoteca.operators.cleaning import transform_cases
    row = quality_report(raw, transform_cases(raw)).first().asDict()
    assert row == {"ano": 2025, "registros_recebidos": 3, "registros_processados": 2,
                   "duplicados": 1, "idade_ausente": 1, "sexo_ausente": 2, "municipio_ausente": 1,
                   "evolucao_ausente": 0, "uti_ausente": 1, "etiologia_nao_identificada": 1}


def test_schema_drift_and_pruning(spark, tmp_path, five_cases):
    root = str(tmp_path / "cases")
    files.write_cases(five_cases.filter("ANO = 2024").drop("PCR_VSR"), root)
    files.write_cases(five_cases.filter("ANO = 2025"), root)
    table = files.read_cases(spark, root)
    assert {"PCR_VSR", "ANO"} <= set(files.available_columns(table))
    assert rows(metrics.case_count(table)) == [(5,)]


def test_reduced_columns_keep_list_order(text_frame):
    df = text_frame([{"EVOLUCAO": 1, "OUTRA": 2, "DT_SIN_PRI": "x"}])
    assert files.reduce_columns(df).columns == ["DT_SIN_PRI", "EVOLUCAO"]
