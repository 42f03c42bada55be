"""Where given sentences stand in documents: exactly, or nearly by pairs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx

#: fixed values: least length of a sentence in characters and words; near is a similarity of pairs of characters, and lengths within a fifth
LEAST_CHARS, LEAST_WORDS, NEAR, SHORTER, LONGER = 10, 4, 0.85, 0.8, 1.2
SEED, SHARE = 3, 0.2
#: a set of seeds up to this size is sent to every task
SENT_BYTES = 16 << 20


def locate(docs: DataFrame, sentences: DataFrame, page_words: int = 300) -> DataFrame:
    """doc_id, item_id, start (word from 0), n_words, score, page, end_page of the best place of each sentence in each document.

    ``docs`` has doc_id and text, ``sentences`` item_id and text. Seeds are runs of three words at their place in the sentence: a
    place is looked at if a fifth of the sentence's seeds stand there. The words there must have a length within a fifth of the
    sentence's and share 0.85 of the pairs of characters; equal words score 1. Best is the highest score, then the first place.
    A sentence may begin on one page and end on the next. Sentences of fewer than 4 words or 10 characters are not looked for."""
    parts = lambda c: F.filter(F.split(tx.clean_text(c), " "), lambda x: x != "")
    seeds = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - SEED), lambda i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(c, i + 1, SEED), " ")).alias("seed")))
    wanted = sentences.select("item_id", parts(F.col("text")).alias("sought")).where((F.size("sought") >= LEAST_WORDS) & (F.length(F.array_join("sought", " ")) >= LEAST_CHARS))
    own = wanted.select("item_id", F.size("sought").alias("n"), F.explode(seeds(F.col("sought"))).alias("s")).select("item_id", "n", F.col("s.at").alias("own_at"), F.col("s.seed").alias("seed"))
    # what is sought decides the way: a set of seeds of proven size goes to every task, a larger one meets the documents in a shuffle
    if own.count() * 40 <= SENT_BYTES:
        own = F.broadcast(own)
    told = docs.select("doc_id", parts(F.col("text")).alias("words")).where(F.size("words") >= SEED)
    hits = told.select("doc_id", F.explode(seeds(F.col("words"))).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.seed").alias("seed")).join(own, "seed")
    places = hits.withColumn("start", F.col("at") - F.col("own_at")).where("start >= 0").groupBy("doc_id", "item_id", "n", "start").agg(F.count("*").alias("shared"))
    good = places.where(F.col("shared") >= SHARE * (F.col("n") - SEED + 1))
    there = good.join(told, "doc_id").join(wanted.select("item_id", F.array_join("sought", " ").alias("sought")), "item_id")
    compared = there.withColumn("found", F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")).drop("words")
    near = compared.where(F.length("found").between(SHORTER * F.length("sought"), LONGER * F.length("sought")))
    scored = near.withColumn("score", F.when(F.col("found") == F.col("sought"), 1.0).otherwise(sim.dice_bigrams(F.col("found"), F.col("sought")))).where(F.col("score") >= NEAR)
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start"))
    page = lambda word: (F.floor(word / page_words) + 1).cast("int")
    return scored.withColumn("k", best).where("k = 1").select(
        "doc_id", "item_id", "start", F.col("n").alias("n_words"), "score", page(F.col("start")).alias("page"), page(F.col("start") + F.col("n") - 1).alias("end_page"),
    )
