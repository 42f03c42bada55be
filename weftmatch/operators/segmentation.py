"""Word lists, and compound words found by the longest match in a dictionary of phrases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: fixed value: words of the longest phrase
MOST_WORDS = 4
#: a dictionary up to this size is sent to every task; a larger one is joined
SENT_BYTES = 16 << 20
#: stands between words and is in none
_PARTS = "\x01"


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a text file, trimmed, in lower case, blank ones ignored, each once."""
    return spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("word")).where("word <> ''").distinct()


def plain_words(text: Column) -> Column:
    """Words in lower case; all but letters and figures parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda x: x != "")


def phrases(words: Column) -> Column:
    """All runs of two to four words, joined by a blank."""

    def of(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.concat(*[of(k) for k in range(2, MOST_WORDS + 1)])


def learnt_phrases(docs: DataFrame, lines: Column, least: int) -> DataFrame:
    """phrase: runs of words within a line that ``least`` or more rows of ``docs`` hold. A row counts its own runs once, before the shuffle.

    Every word of such a run stands in ``least`` rows too, so runs are made between other words only. There are at most as many of these
    words as all rows together have different ones, divided by ``least``."""
    worded = docs.select(F.transform(lines, lambda x: plain_words(x)).alias("worded_"))
    counted = worded.select(F.explode(F.array_distinct(F.flatten("worded_"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = [r[0] for r in counted.where(F.col("n") >= least).select("word").collect()]
    # other words part a line
    parts = lambda words: F.split(F.array_join(F.transform(words, lambda w: F.when(w.isin(often), w).otherwise(_PARTS)), " "), f" ?{_PARTS} ?")
    own = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform("worded_", parts)), lambda part: tx.let(F.split(part, " "), phrases))))
    return worded.select(F.explode(own).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("phrase")


def cover(words: list[str], known) -> list[str]:
    """From left to right the longest known phrase, its words joined by ``_``, or else a single word."""
    out, i = [], 0
    while i < len(words):
        for k in range(min(MOST_WORDS, len(words) - i), 0, -1):
            if k == 1 or " ".join(words[i : i + k]) in known:
                out.append("_".join(words[i : i + k]))
                i += k
                break
    return out


def segmented(rows: DataFrame, words: str, dictionary: DataFrame, name: str = "segments") -> DataFrame:
    """Adds ``name``: the words of each row put together to phrases of the dictionary (column ``phrase``).

    A dictionary within ``SENT_BYTES`` goes to every task and rows stay where they are. Beyond that each row's own runs of
    words are looked up in it by a join, and the row gets those that are known."""
    spark, dictionary = rows.sparkSession, dictionary.persist()
    size = dictionary.agg(F.coalesce(F.sum(F.octet_length("phrase") + 50), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        known = spark.sparkContext.broadcast(frozenset(r[0] for r in dictionary.select("phrase").collect()))
        dictionary.unpersist()

        @F.arrow_udf("array<string>")
        def by_set(column: pa.Array) -> pa.Array:
            return pa.array([None if x is None else cover(x, known.value) for x in column.to_pylist()], pa.list_(pa.string()))

        return rows.withColumn(name, by_set(words))

    @F.arrow_udf("array<string>")
    def by_row(column: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cover(x, set(f or ())) for x, f in zip(column.to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.string()))

    # rows with the same words have the same segments, so the words are the key
    distinct = rows.select(F.col(words).alias("words_")).distinct().withColumn("row_", F.xxhash64("words_"))
    runs = distinct.select("words_", "row_", F.explode(F.array_distinct(phrases(F.col("words_")))).alias("phrase"))
    found = runs.join(dictionary.select("phrase"), "phrase", "left_semi").groupBy("row_", "words_").agg(F.collect_list("phrase").alias("found_"))
    keyed = rows.withColumn("row_", F.xxhash64(words)).withColumn("words_", F.col(words)).join(found, ["row_", "words_"], "left")
    return keyed.withColumn(name, by_row(words, "found_")).drop("row_", "words_", "found_")


def frequent_words(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """word: words that stand in at least ``percent`` of all documents. There are at most 100 / percent times as many as a document has."""
    n = docs.select(key).distinct().count()
    each = docs.select(key, F.explode(F.array_distinct(plain_words(F.col(text)))).alias("word")).distinct()
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") * 100 >= percent * n).select("word")
