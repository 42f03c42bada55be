"""Learnt phrases."""

from pyspark.sql import functions as F

from weftmatch.operators import segmentation as sg


def test_phrases_are_made_between_frequent_words_only(spark):
    docs = spark.createDataFrame([(i, f"we see the u{i} sea again\nthe v{i} sea") for i in range(6)] + [(9, None)], "doc_id long, text string")
    found = sg.learnt_phrases(docs, F.split("text", "\n"), 3)
    assert {r[0] for r in found.collect()} == {"we see", "see the", "we see the", "sea again"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # words of a line are made once
