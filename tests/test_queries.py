"""Every registered query against its check SQL, and the plans behind them."""

import datetime
import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from casoteca.operators import metrics  # noqa: E402
from casoteca.operators.filters import Filters  # noqa: E402
from casoteca.sources.derived import raw_cases, stored_cases  # noqa: E402
from casoteca.operators.cleaning import transform_cases  # noqa: E402

from conftest import SF  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not found")
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.date):
        return value.isoformat()[:10]
    return value


def table(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return ([names[i] for i in order],
            sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_check(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(CHECKS[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert table(df.columns, df.collect()) == want


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf):
    plan = plan_of(metrics.mortality(stored_cases(spark, sf), Filters(ano_inicio=2025, uf="x")))
    assert plan.count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(ANO" in plan and "EqualTo(UF,X)" in plan
    assert "ReadSchema: struct<DESFECHO_NORMALIZADO:string,UF:string>" in plan


def test_comparison_reads_once(spark, sf):
    plan = plan_of(metrics.compare(stored_cases(spark, sf), Filters(uf="a"), Filters(uf="b")))
    assert plan.count("FileScan") == 1


def test_ranking_keeps_the_top_per_task(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(metrics.ranking(stored_cases(spark, sf)))


def test_no_python_in_the_data_path(spark, sf):
    plan = plan_of(transform_cases(raw_cases(spark, sf)))
    assert "Python" not in plan and "Pandas" not in plan
