"""Every report query against DuckDB over the same tables, and its results on the rows that matter."""

import duckdb
import pytest

from weftmatch.plans import reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in reports.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(reports.SQL))
def test_report_query_equals_sql(spark, duck, name):
    found = duck.execute(reports.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = reports.run(name, spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert _rows(map(tuple, got.collect()), got.columns) == _rows(found.fetchall(), columns)


def test_states_and_levels(spark):
    states = {r.state: r.ratio for r in reports.run("status_case", spark, SF).collect()}
    assert states.get("Đang xử lý") is None and states.get("Lỗi", 0.0) == 0.0
    cards = reports.run("kpi_cards", spark, SF).first()
    assert cards.total == cards.scored + cards.failed + cards.in_progress
    assert sum(r.n for r in reports.run("rating_distribution", spark, SF).collect()) == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").count()

