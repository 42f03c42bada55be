"""Searches, marks, selections and rankings against their SQL, and functions on made values."""

from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmatch.functions import text as tx
from weftmatch.plans import browse
from weftmatch.sources import folders

SF = "/root/testdata/sf0.001"
SLOW = {"top3_sources", "exact_match_classes"}


@pytest.mark.parametrize("name", sorted(set(browse.ORACLES) - SLOW))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(browse.ORACLES[name])
    names = [c[0] for c in want.description]
    tidy = lambda rows: sorted(tuple("" if x is None else f"{float(x):.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)
    assert tidy(browse.QUERIES[name](spark, SF).select(*names).collect()) == tidy(want.fetchall())


def test_workbooks_hold_every_account_once(spark):
    text = "".join(r.value for r in browse.accounts_workbook(spark, SF).collect())
    book = ElementTree.fromstring(text.split("?>", 1)[1])
    ns = "{urn:schemas-microsoft-com:office:spreadsheet}"
    ids = [r.find(f"{ns}Cell/{ns}Data").text for sheet in book.iter(f"{ns}Worksheet") for r in list(sheet.iter(f"{ns}Row"))[1:]]
    n = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").union(spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey")).distinct().count()
    assert len(ids) == len(set(ids)) == n
    assert sum(r.value.startswith("<Row>") for r in browse.ratings_workbook(spark, SF).collect()) == 7 + spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").count()


def test_folders_of_reports(spark, tmp_path):
    for where, data in (("Đồ án/Bài một.txt", "\ufeffnội dung\n"), ("Đồ án/a+b.TXT", "x"), ("Khoá luận/hai.pdf", "%PDF"), ("gốc.md", "m"), ("Khoá luận/bỏ.exe", "z"), ("_ẩn/không.txt", "n")):
        (tmp_path / where).parent.mkdir(exist_ok=True)
        (tmp_path / where).write_text(data, encoding="utf-8")
    got = sorted((r.kind or "", r.title, r.ending, r.text) for r in folders.scan(spark, f"file://{tmp_path}").collect())
    assert [g for g in got if g[1] != "không"] == [("", "gốc", "md", "m"), ("Khoá luận", "hai", "pdf", None), ("Đồ án", "Bài một", "txt", "nội dung\n"), ("Đồ án", "a+b", "txt", "x")]


def test_each_equal_sentence_is_one_row(spark):
    rows = browse.exact_match_classes(spark, SF).collect()
    pairs = browse.overlap.exact_match_pairs(spark, SF).count()
    assert len({r.sentence_hash for r in rows}) == len(rows) and sum(r.n_pairs for r in rows) == pairs


@pytest.mark.parametrize("values, p, want", [([5], 0.9, 5), ([3, 1, 2, 4], 0.5, 2), ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 0.9, 10)])
def test_percentile_is_a_value_that_occurs(spark, values, p, want):
    assert spark.range(1).select(tx.floor_percentile(F.array(*map(F.lit, values)), p)).first()[0] == want


def test_marks_keep_the_case_and_quote_signs(spark):
    row = spark.range(1).select(tx.mark_keyword(F.lit("C++ and c++, Ông ÔNG"), "c++"), tx.mark_keyword(F.lit("Ông ÔNG ong"), "ông"), tx.mark_keyword(F.lit("x"), "")).first()
    assert tuple(row) == ("<mark>C++</mark> and <mark>c++</mark>, Ông ÔNG", "<mark>Ông</mark> <mark>ÔNG</mark> ong", "x")
