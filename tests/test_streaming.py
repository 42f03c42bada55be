"""Streaming scoring against the batch query; replacement by key; tables that follow their source."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from weftmatch.config import EngineConfig
from weftmatch.operators import matching as m
from weftmatch.operators import sentences as st
from weftmatch.operators import statistics as stats
from weftmatch.plans import overlap
from weftmatch.sources import storage
from weftmatch.sources.versions import Versions, replace_by_key
from weftmatch.streaming import scoring

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_runs_twice(spark, tmp_path):
    index = st.sentence_index(overlap.documents(spark, SF), EngineConfig())
    idf = st.vocab_idf(index)
    want = sorted(map(tuple, stats.report_stats(index, m.sentence_matches(index, st.term_weights(index, idf))).collect()))
    samples = index.where("is_sample")
    subs = overlap.documents(spark, SF).where("NOT is_sample").select("doc_id", "text")
    subs.repartition(2).write.parquet(f"{tmp_path}/in")
    columns = stats.report_stats(index, m.sentence_matches(index, st.term_weights(index, idf))).columns
    for run in range(2):  # a second query from the start replaces every result by the same
        stream = spark.readStream.schema(subs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        scoring.stream_score(stream, samples, idf, st.term_weights(samples, idf), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint-{run}").awaitTermination(200)
        assert sorted(map(tuple, Versions(spark, f"file://{tmp_path}/out").read("rows").select(*columns).collect())) == want


def test_replace_by_key(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "doc_id long, n long")
    path = f"file://{tmp_path}/kept"
    replace_by_key(rows([(1, 1), (1, 2), (2, 3)]), path, "doc_id")
    for token in ("a", "a", "b"):
        replace_by_key(rows([(1, 9)]), path, "doc_id", token)
    there = Versions(spark, path)
    assert sorted((r.doc_id, r.n) for r in there.read("rows").collect()) == [(1, 9), (2, 3)] and there.manifest()["number"] == 3
    assert there.tidy() >= 1 and sorted((r.doc_id, r.n) for r in there.read("rows").collect()) == [(1, 9), (2, 3)]


def test_crash_between_tables_leaves_the_version_before(spark, tmp_path):
    there = Versions(spark, f"file://{tmp_path}/bundle")
    of = lambda n: spark.range(n).withColumn("v", F.lit(n))
    assert there.commit({"a": of(2), "b": of(3)}, "one") == 1
    broken = of(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"), "v")
    with pytest.raises(Exception):  # noqa: B017
        there.commit({"a": of(7), "b": broken}, "two")
    assert (there.read("a").count(), there.read("b").count(), there.manifest()["number"]) == (2, 3, 1)
    # a manifest that its writer did not finish counts as none
    (tmp_path / "bundle/manifests/v000000002.json").write_text('{"number": 2, "tab')
    assert there.manifest()["number"] == 1
    assert there.commit({"a": of(7), "b": of(8)}, "two") == 3 == there.commit({"a": of(1)}, "two")
    assert (there.read("a").count(), there.read("b").count()) == (7, 8)
    there.tidy()
    assert (there.read("a").count(), there.read("b").count(), there._numbers()) == (7, 8, [3])


def test_crash_in_a_replacement_keeps_the_rows_of_others(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    replace_by_key(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("n")), path, "k", buckets=4)
    bad = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(2).cast("int").alias("n"))
    with pytest.raises(Exception):  # noqa: B017
        replace_by_key(bad, path, "k", buckets=4)
    rows = Versions(spark, path).read("rows")
    assert rows.count() == 200 and rows.where("n = 1").count() == 200
    replace_by_key(spark.range(50).select(F.col("id").alias("k"), F.lit(2).alias("n")), path, "k", buckets=4)
    rows = Versions(spark, path).read("rows")
    assert (rows.count(), rows.where("n = 2").count()) == (200, 50)


def test_workbook_of_several_sheets(spark, tmp_path):
    first = spark.createDataFrame([(2, "b & c", None), (1, "a < b", 1.5)], "n long, t string, x double")
    storage.workbook([("Tổng & hợp", first, ["n"]), ("Rỗng", first.limit(0), ["n"]), ("Nhiều", spark.range(500).repartition(7), ["id"])]).write.text(f"{tmp_path}/book")
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "book").glob("part-*")))
    ns = {"s": "urn:schemas-microsoft-com:office:spreadsheet"}
    book = ElementTree.fromstring(text.encode())
    cells = [[["" if (d := c.find("s:Data", ns)) is None else d.text for c in r.findall("s:Cell", ns)] for r in sheet.iter(f"{{{ns['s']}}}Row")] for sheet in book.findall("s:Worksheet", ns)]
    assert cells[0] == [["n", "t", "x"], ["1", "a < b", "1.5"], ["2", "b & c", ""]] and cells[1] == [["n", "t", "x"]]
    assert [r[0] for r in cells[2]] == ["id", *map(str, range(500))]


def test_materialised_follows_its_source(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(path)
        assert [storage.materialised(spark, "copy", path, lambda: spark.read.parquet(path)).count() for _ in range(2)] == [n, n]


def test_short_items_are_found_in_documents(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha beta gamma delta eps zeta.", "src5"), (2, "gamma delta", "src5")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "gamma delta eps"), (8, "Beta, gamma delta eps zeta"), (9, "eps delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in overlap.containment_audit(spark, str(tmp_path)).collect()} == {(1, 7), (1, 8)}


def test_sheet_rows_and_upsert(spark):
    df = spark.createDataFrame([(2, "a<b"), (1, None)], "n long, t string")
    assert [r.value for r in storage.sheet_rows(df, "S", ["n"]).collect()][0] == '<Row><Cell><Data ss:Type="Number">1</Data></Cell><Cell/></Row>'
    new = spark.createDataFrame([(1, "x"), (3, "y")], "n long, t string")
    assert {tuple(r) for r in storage.upsert(df, new, ["n"]).collect()} == {(1, "x"), (2, "a<b"), (3, "y")}
    assert df.select(F.count("*")).first()[0] == 2
