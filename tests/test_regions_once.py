"""Lines are brought to their normal form once."""

from pyspark.sql import functions as F

from weftmatch.operators import regions as rg


def test_lines_are_made_normal_once(spark):
    docs = spark.createDataFrame([(1, "Cover\nMỞ ĐẦU\nWe begin.\n1. Then")], "doc_id long, text string").select("doc_id", F.split("text", "\n").alias("lines"))
    found = rg.with_regions(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\\p{Z}") == 1
    assert found.columns == ["doc_id", "lines", "regions", "compared"] and found.first()["compared"] == [3, 4]
