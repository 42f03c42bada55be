"""Documents to paragraphs, sentences and features, without a shuffle: every document is worked on within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx


def numbered_sentences(text: Column) -> Column:
    """Array of (paragraph, sentence): eligible sentences; paragraphs count only if they have one."""
    by_paragraph = F.transform(F.split(text, "\n"), lambda p: F.filter(tx.split_sentences(p), tx.eligible))
    filled = F.filter(by_paragraph, lambda a: F.size(a) > 0)
    return F.flatten(F.transform(filled, lambda a, i: F.transform(a, lambda s: F.struct((i + 1).alias("paragraph"), s.alias("sentence")))))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, is_sample, idx (from 1), paragraph_id, content, clean_content of every eligible sentence."""
    number = F.col("s.paragraph").cast("string")
    rows = docs.select("doc_id", "is_sample", F.posexplode(numbered_sentences(F.col("text"))).alias("pos", "s"))
    return rows.select(
        "doc_id", "is_sample", (F.col("pos") + 1).alias("idx"),
        F.concat(F.lit("DOAN_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0")).alias("paragraph_id"),
        F.col("s.sentence").alias("content"), tx.clean_text(F.col("s.sentence")).alias("clean_content"),
    )


def sentence_index(docs: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """``sentences`` with sentence_hash, token_count (content words), words (distinct) and fingerprints."""
    config = config or EngineConfig()
    rows = sentences(docs).withColumn("tokens", tx.words_of_clean(F.col("clean_content")))
    return rows.select(
        "doc_id", "is_sample", "idx", "paragraph_id", "content", "clean_content",
        F.size(tx.content_of_clean(F.col("clean_content"))).alias("token_count"), F.md5("clean_content").alias("sentence_hash"),
        F.array_distinct("tokens").alias("words"), tx.fingerprints(tx.kgram_hashes(F.col("tokens"), config.k), config.window).alias("fingerprints"),
    )


def narrow(index: DataFrame) -> DataFrame:
    """``sentence_index`` as it is stored: without what follows from the sentence, and with hashes as bytes and fingerprints as ints."""
    return index.drop("clean_content", "words").withColumns({"sentence_hash": F.unhex("sentence_hash"), "fingerprints": F.col("fingerprints").cast("array<int>")})


def widened(rows: DataFrame) -> DataFrame:
    """``narrow`` rows with clean_content and words, which are made where they are read."""
    clean = rows.withColumn("clean_content", tx.clean_text(F.col("content")))
    return clean.withColumn("words", F.array_distinct(tx.words_of_clean(F.col("clean_content"))))


def vocab_idf(index: DataFrame) -> DataFrame:
    """term, df, idf = max(0, log10(N / df)) over the sample documents; the single count N is joined as a scalar."""
    sample = index.where("is_sample")
    terms = sample.select("doc_id", F.explode(tx.tfidf_of_clean(F.col("clean_content"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = sample.agg(F.countDistinct("doc_id").alias("n"))
    return terms.join(F.broadcast(n)).select("term", "df", F.greatest(F.lit(0.0), F.log10(F.col("n") / F.col("df"))).alias("idf"))


def term_counts(index: DataFrame) -> DataFrame:
    """term, df, n_docs of the sample documents of ``index``, which may be a share of all; ``idf_of_counts`` adds shares up."""
    sample = index.where("is_sample")
    terms = sample.select("doc_id", F.explode(tx.tfidf_of_clean(F.col("clean_content"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = sample.agg(F.countDistinct("doc_id").alias("n_docs"))
    return terms.withColumn("n_docs", F.lit(0).cast("long")).unionByName(n.select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), "n_docs"))


def idf_of_counts(counts: DataFrame) -> DataFrame:
    """``vocab_idf`` from the ``term_counts`` of shares of the documents."""
    n = counts.agg(F.sum("n_docs").alias("n"))
    terms = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    return terms.join(F.broadcast(n)).select("term", "df", F.greatest(F.lit(0.0), F.log10(F.col("n") / F.col("df"))).alias("idf"))


def term_weights(index: DataFrame, idf: DataFrame) -> DataFrame:
    """doc_id, idx, term, weight (max-normalised frequency times idf, where above 0) of every sentence."""
    terms = index.select("doc_id", "idx", tx.tfidf_of_clean(F.col("clean_content")).alias("t")).where(F.size("t") > 0)
    # runs of the sorted tokens: where each begins, up to where the next does
    runs = lambda t: tx.let(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2))), lambda s: F.transform(s, lambda p, k: F.struct(F.get(t, p - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - p).alias("n"))))
    counted = tx.let(F.array_sort(F.col("t")), runs)
    shares = tx.let(counted, lambda c: tx.let(F.array_max(F.transform(c, lambda x: x["n"])), lambda most: F.transform(c, lambda x: F.struct(x["term"].alias("term"), (x["n"] / most).alias("tf")))))
    flat = terms.select("doc_id", "idx", F.explode(shares).alias("c")).select("doc_id", "idx", "c.term", "c.tf")
    return flat.join(idf.where("idf > 0"), "term").select("doc_id", "idx", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def incremental_idf(known: DataFrame, index: DataFrame, n_now: int) -> DataFrame:
    """New terms of new documents: idf = log10(N now / df among them), at least 0; known terms keep theirs."""
    new = index.select("doc_id", F.explode(tx.tfidf_of_clean(F.col("clean_content"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    added = new.join(known.select("term"), "term", "left_anti")
    return added.select("term", "df", F.greatest(F.lit(0.0), F.log10(F.lit(float(n_now)) / F.col("df"))).alias("idf"))
