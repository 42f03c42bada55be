"""Changes through tables and nested arrays on made rows; every record query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmatch.operators import records as rc
from weftmatch.plans import records

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
#: these stand on the sentence matches, whose SQL takes long; they are compared at a larger scale by the driver
SLOW = {"passage_texts", "patchwork_texts", "source_drilldown", "page_ranges"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(records.ORACLES) - SLOW))
def test_record_query_gives_the_rows_of_its_sql(spark, duck, name):
    want = duck.execute(records.ORACLES[name])
    names = [c[0] for c in want.description]
    got = records.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    tidy = lambda rows: sorted(tuple("" if x is None else f"{float(x):.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)
    rows = got.select(*names).collect()
    assert rows and tidy(rows) == tidy(want.fetchall())


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame([(1, [3, 1, 3, 2], "x"), (2, [], "x"), (3, None, "y"), (4, [5], "y"), (5, [1], "z")], "id int, who array<int>, item_ string")


def test_keys_are_renamed_inside_arrays(spark, nested):
    names = spark.createDataFrame([(3, 30), (5, 50), (9, 90)], "old int, new int")
    got = rc.rename_nested(nested, "id", "who", names, "old", "new")
    assert got.columns == nested.columns
    assert sorted((r.id, r.who) for r in got.collect()) == [(1, [30, 1, 30, 2]), (2, []), (3, None), (4, [50]), (5, [1])]


def test_keys_are_deleted_inside_arrays(spark, nested):
    gone = spark.createDataFrame([(3,), (5,), (3,)], "k int")
    assert sorted((r.id, r.who) for r in rc.without_nested(nested, "id", "who", gone, "k").collect()) == [(1, [1, 2]), (2, []), (3, None), (4, []), (5, [1])]


def test_one_set_of_keys_for_all_tables(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(2, 5), (2, 6), (3, 7)], "y int, z int")
    left = rc.without_keys({"a": (a, "x"), "b": (b, "y")}, spark.createDataFrame([(2,), (2,)], "k int"), "k")
    assert {tuple(r) for r in left["a"].collect()} == {(1,), (None,)} and [tuple(r) for r in left["b"].collect()] == [(3, 7)]


def test_taken_codes_are_skipped(spark):
    taken = spark.createDataFrame([("BC000007",), ("BC8",), ("BC000010",), ("XX000099",), (None,)], "code string")
    got = rc.next_codes(spark.range(1, 4).select(F.col("id").cast("int").alias("n")), taken, "code", "BC", 6).collect()
    assert sorted(r.code for r in got) == ["BC000011", "BC000012", "BC000013"]
    wide = spark.createDataFrame([("BC1",), ("BC02",)], "code string")
    assert sorted(r.code for r in rc.next_codes(spark.range(1, 3).select(F.col("id").cast("int").alias("n")), wide, "code", "BC", 1).collect()) == ["BC3", "BC4"]


def test_latest_row_of_a_key(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d")], "k int, at int, v string")
    assert sorted((r.k, r.v) for r in rc.latest(rows, ["k"], ["at", "v"], ["at", "v"]).collect()) == [(1, "c"), (2, "d")]


@pytest.mark.parametrize("x, want", [(None, "0%"), (3.0, "3%"), (50.95, "51%"), (2.99, "3%"), (12.34, "12.3%"), (0.05, "0.1%"), (100.0, "100%")])
def test_percent_text(spark, x, want):
    assert spark.range(1).select(records.percent_text(F.lit(x).cast("double"))).first()[0] == want


def test_outlined_lines_with_sharp_s_equal_their_sql(spark, tmp_path):
    """The SQL's capital of ß is one letter: three letters make no heading, and the rest of a mark keeps it."""
    docs = spark.createDataFrame([(1, "a\nb\nc\naa ß\ne\nf\ng\nh\ni\nÖ. ein Maß"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("heading_form", "numbering_split"):
        want = con.execute(records.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(records.QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == sorted(want.fetchall())
