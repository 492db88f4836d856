"""Large counts, missing scores, uneven files and emptied years."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casoteca.functions import fixed, ordered
from casoteca.ml import evaluate
from casoteca.operators import explore, ingest
from casoteca.sources import files

HEADER = "TP_IDADE;NU_IDADE_N;SG_UF;ID_MUNICIP;CO_MUN_RES;EVOLUCAO;UTI\n"


def scored(spark, *values):
    return spark.createDataFrame(values, "label int, score double")


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_an_error(spark, bad):
    with pytest.raises(Exception, match="ausente ou NaN"):
        evaluate.ranking_metrics(scored(spark, (1, 0.9), (0, 0.2), (1, bad))).collect()


def test_curve_starts_at_the_origin(spark):
    points = evaluate.roc_points(scored(spark, (1, 0.9), (0, 0.2))).orderBy(F.desc("limiar")).collect()
    assert [(p.limiar, p.tfp, p.tvp) for p in points] == [(math.inf, 0, 0), (0.9, 0, 1), (0.2, 1, 1)]


def test_areas_of_ten_billion_rows(spark, monkeypatch):
    table = spark.createDataFrame(
        [(0.9, 6 * 10**9, 0, 6 * 10**9, 0, 10**10, 10**10), (0.1, 4 * 10**9, 10**10, 10**10, 10**10, 10**10, 10**10)],
        "limiar double, positivos long, negativos long, vp long, fp long, total_positivos long, total_negativos long")
    monkeypatch.setattr(evaluate, "threshold_table", lambda *_: table)
    assert evaluate.ranking_metrics(table).first().auc == pytest.approx(0.8)


def test_density_far_from_zero(spark):
    near = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 7)], "NU_IDADE_N double")
    far = near.select((F.col("NU_IDADE_N") + 1e9).alias("NU_IDADE_N"))
    a, b = ([r.densidade for r in explore.age_density(x).orderBy("ponto").collect()] for x in (near, far))
    assert a == pytest.approx(b, rel=1e-4)


def test_files_of_one_scan_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EVOLUCAO;UTI\n1;2\n")
    (tmp_path / "b.csv").write_text("UTI;EVOLUCAO\n1;2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.csv_scan(spark, str(tmp_path)).collect()


def test_fields_of_a_line(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a;b\n1;"x;y"\n2\n')
    assert [tuple(r) for r in files.csv_scan(spark, str(path)).collect()] == [("1", "x;y"), ("2", None)]
    path.write_text("a;b\n1;2;3\n")
    with pytest.raises(Exception, match="campos a mais"):
        files.csv_scan(spark, str(path)).select("a").collect()


def test_quoted_line_breaks_are_one_record(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + '3;40;PR;"CURI\nTIBA";1;1;2\n')
    cases, report = str(tmp_path / "cases"), str(tmp_path / "quality")
    ingest.ingest_year(spark, str(path), cases, report, 2024, multi_line=True)
    assert files.read_cases(spark, cases).count() == 1


def test_an_emptied_year_replaces_the_old_one(spark, tmp_path):
    path, cases, report = (str(tmp_path / n) for n in ("raw.csv", "cases", "quality"))
    Path(path).write_text(HEADER + "3;40;PR;CURITIBA;1;1;2\n")
    ingest.ingest_year(spark, path, cases, report, 2024)
    ingest.ingest_year(spark, path, cases, report, 2025)
    Path(path).write_text(HEADER)
    ingest.ingest_year(spark, path, cases, report, 2024, force=True)
    assert [r.ANO for r in files.read_cases(spark, cases).select("ANO").collect()] == [2025]
    found = [json.loads(line) for p in Path(report).rglob("*.json") for line in p.read_text().splitlines()]
    assert {r["ano"]: r["registros_recebidos"] for r in found} == {2024: 0, 2025: 1}


def test_state_filter_finds_its_column(spark):
    for column in fixed.STATE_COLUMNS:
        df = spark.createDataFrame([("pr", 1), ("SC", 2), (None, 3)], f"{column} string, n int")
        assert [r.n for r in explore.filter_state(df, "PR").collect()] == [1]
    bare = spark.createDataFrame([(1,), (2,)], "n int")
    assert explore.filter_state(bare, "PR").count() == 2
    both = spark.createDataFrame([("PR", "SC")], ", ".join(f"{c} string" for c in fixed.STATE_COLUMNS[:2]))
    assert explore.filter_state(both, "PR").count() == 1 and explore.filter_state(both, "SC").count() == 0


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 0.5).alias("x"))
    few = ordered._default_blocks(df)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 20)
    assert ordered._default_blocks(df) == 150 > few
    out = ordered.running_totals(df, "x", {"n": F.count(F.lit(1))}, by=["g"])
    assert [r.n__acum for r in out.where("g = 1").orderBy("x").collect()] == list(range(1, 1501))


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_in_no_cell(spark, bad):
    df = scored(spark, (1, 0.9), (0, 0.2), (1, bad))
    for table in (evaluate.confusion_matrix(df), evaluate.classification_report(df, [0.5]),
                  evaluate.threshold_metrics(df)):
        with pytest.raises(Exception, match="ausente ou NaN"):
            table.collect()


def test_state_queries_without_enough_rows(spark, monkeypatch):
    from casoteca.plans import models as plans
    from casoteca.plans.registry import QUERIES
    monkeypatch.setattr(plans, "_state_benchmarks", lambda *_: {})
    for name in ("model_comparison", "feature_importance"):
        table = QUERIES[name](spark, "")
        assert table.count() == 0 and "alvo" in table.columns
