"""Queries of the overlap engine over ``documents``, and the same in DuckDB SQL.

Documents of the sources src0 and src1 are submissions; all others are samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..functions.text import ABBREVIATIONS
from ..operators import matching as m
from ..operators import sentences as st
from ..operators import sequences as sq
from ..operators import statistics as stats
from ..sources.storage import materialised

CONFIG = EngineConfig()
#: a side of a join up to this size goes to every task
SENT_BYTES = 8 << 20
#: what is shuffled at a time: sentences, classes with their fingerprints, candidate pairs that are compared, exact matches that the submissions of a share have (about)
ROWS_AT_ONCE, CLASSES_AT_ONCE, PAIRS_AT_ONCE, EXACT_AT_ONCE = 4_000_000, 1_200_000, 1_000_000, 100_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~F.col("source").isin("src0", "src1")).alias("is_sample"))


def spread(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows on all cores where the files are too few for that; a large table stays as it is read."""
    n = spark.sparkContext.defaultParallelism
    return docs.repartition(2 * n) if docs.rdd.getNumPartitions() < n else docs


def _parts(n: float, at_once: int, *columns: str) -> list[Column]:
    """Conditions that deal rows out by ``columns``, so that ``n`` of them make parts of about ``at_once``."""
    k = 1 + int(n) // at_once
    return [F.pmod(F.xxhash64(*columns), F.lit(k)) == i if k > 1 else F.lit(True) for i in range(k)]


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature index, written once a session: it costs far more than the joins over it."""
    build = lambda: st.narrow(st.sentence_index(spread(spark, documents(spark, sf_dir)), CONFIG))
    return st.widened(materialised(spark, "sentence_index", f"{sf_dir}/documents.parquet", build, repr(CONFIG)))


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, index = f"{sf_dir}/documents.parquet", _index(spark, sf_dir)
    counts = materialised(spark, "term_count", source, lambda: (st.term_counts(index.where(x)) for x in _parts(index.count(), ROWS_AT_ONCE, "doc_id")), repr(CONFIG))
    return materialised(spark, "vocab", source, lambda: st.idf_of_counts(counts), repr(CONFIG))


def _shares(spark: SparkSession, sf_dir: str) -> list[Column]:
    """Shares of the submissions. What grows with pairs of copies is made a share at a time, whole but never shuffled all at once."""
    n = materialised(spark, "n_exact", f"{sf_dir}/documents.parquet", lambda: m.n_exact(_index(spark, sf_dir)), repr(CONFIG)).first()[0]
    return _parts(n, EXACT_AT_ONCE, "doc_id")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each text: copies are compared once."""
    return materialised(spark, "sentence_class", f"{sf_dir}/documents.parquet", lambda: map(m.classes, _by(_index(spark, sf_dir), "sentence_hash")), repr(CONFIG))


def _by(rows: DataFrame, *columns: str) -> list[DataFrame]:
    return [rows.where(x) for x in _parts(rows.count(), ROWS_AT_ONCE, *columns)]


def _candidates(spark: SparkSession, sf_dir: str, enough: bool = False) -> list[DataFrame]:
    """Candidate pairs of classes, a part of the fingerprints at a time."""
    rows = _classes(spark, sf_dir)
    return [m.candidate_pairs(rows, x, enough) for x in _parts(rows.count(), CLASSES_AT_ONCE, "fp")]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of classes with enough shared fingerprints; every step of the comparison reads them."""
    build = lambda: (m.overlapping(x).select(*m.PAIR) for x in _candidates(spark, sf_dir, enough=True))
    return materialised(spark, "candidate_pair", f"{sf_dir}/documents.parquet", build, repr(CONFIG))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the index that are in a candidate pair; no other one is compared."""
    rows, pairs = _index(spark, sf_dir).select("doc_id", "idx", "is_sample", "content", "fingerprints"), _pairs(spark, sf_dir)
    build = lambda: (m.in_pairs(x, pairs) for x in _by(rows, "doc_id", "idx"))
    return st.widened(materialised(spark, "told_sentence", f"{sf_dir}/documents.parquet", build, repr(CONFIG)))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        told = _told(spark, sf_dir)
        return m.features(told, st.term_weights(told, _vocab(spark, sf_dir)))

    return materialised(spark, "feature", f"{sf_dir}/documents.parquet", build, repr(CONFIG))


def _of_copies(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    return m.of_copies(_index(spark, sf_dir), _classes(spark, sf_dir), pairs)


def _compared(spark: SparkSession, sf_dir: str, sets: bool = False) -> DataFrame:
    """Candidate pairs of classes with their similarities (those of ``sets`` alone), a part of the pairs at a time."""
    rows, pairs = (_told if sets else _features)(spark, sf_dir), _pairs(spark, sf_dir)
    build = lambda: ((m.compared_sets if sets else m.compared_features)(rows, pairs.where(x)) for x in _parts(pairs.count(), PAIRS_AT_ONCE, "doc_id", "idx"))
    return materialised(spark, "compared_sets" if sets else "compared", f"{sf_dir}/documents.parquet", build, repr(CONFIG))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that are not exact."""
    found = m.scored(_compared(spark, sf_dir), CONFIG).select(*m.PAIR, "similarity", "cosine", "winnowing", "jaccard")
    build = lambda: _of_copies(spark, sf_dir, found)
    return materialised(spark, "near_match", f"{sf_dir}/documents.parquet", build, repr(CONFIG))


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index and all matches. Exact ones are as many as pairs of copies; they are made where they are read, not stored."""
    index = _index(spark, sf_dir)
    return index, m.all_matches(index, _near(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each matched submission sentence."""
    build = lambda: m.matched(_index(spark, sf_dir), _near(spark, sf_dir))
    return materialised(spark, "matched_sentence", f"{sf_dir}/documents.parquet", build, repr(CONFIG))


def _islands(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The islands of each share of the submissions."""
    index, rows, near = _index(spark, sf_dir), _matched(spark, sf_dir), _near(spark, sf_dir)
    place = materialised(spark, "exact_place", f"{sf_dir}/documents.parquet", lambda: sq.exact_places(rows, index), repr(CONFIG))
    return [sq.passage_islands_of_copies(rows.where(x), near.where(x), index, place) for x in _shares(spark, sf_dir)]


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched sentences, passages and patchworks. Exact matches are made for the sentences of possible patchworks only."""
    source, rows, near = f"{sf_dir}/documents.parquet", _matched(spark, sf_dir), _near(spark, sf_dir)
    passages = materialised(spark, "passage", source, lambda: map(sq.best_islands, _islands(spark, sf_dir)), repr(CONFIG))
    runs = materialised(spark, "patchwork_run", source, lambda: sq.patchwork_runs(rows, sq.covered(passages)), repr(CONFIG))
    build = lambda: sq.best_patchworks(sq.patchwork_islands(m.matches_of(_index(spark, sf_dir), near, runs), runs))
    return rows, passages, materialised(spark, "patchwork", source, build, repr(CONFIG))


def sentences(spark, d):
    return st.sentences(documents(spark, d)).select("doc_id", "idx", "paragraph_id", "content")


def paragraph_ids(spark, d):
    return st.sentences(documents(spark, d)).groupBy("doc_id", "paragraph_id").agg(F.count("*").alias("n_sentences"))


def content_tokens(spark, d):
    t = tx.content_tokens(F.col("content"))
    return st.sentences(documents(spark, d)).select("doc_id", "idx", F.size(t).alias("token_count"), F.array_join(t, " ").alias("tokens"))


def tfidf_tokens(spark, d):
    t = tx.tfidf_tokens(F.col("content"))
    return st.sentences(documents(spark, d)).select("doc_id", "idx", F.array_join(t, " ").alias("tokens"))


def syllable_filter(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(tx.syllables(F.col("line"))).alias("n_syllables"), F.count_if(tx.eligible(F.col("line"))).alias("n_eligible"))


def md5_sentence(spark, d):
    return st.sentences(documents(spark, d)).select("doc_id", "idx", F.md5("clean_content").alias("sentence_hash"))


def poly_hash_kgrams(spark, d):
    h = tx.kgram_hashes(tx.words_of_clean(F.col("clean_content")), 3)
    return st.sentences(documents(spark, d)).select("doc_id", "idx", F.array_join(h.cast("array<string>"), ",").alias("hashes"))


def winnow_fingerprints(spark, d):
    return _index(spark, d).select("doc_id", "idx", F.size("fingerprints").alias("n"), F.array_join(F.col("fingerprints").cast("array<string>"), ",").alias("fingerprints"))


def vocab_idf(spark, d):
    return _vocab(spark, d).select("term", "df", F.round("idf", 6).alias("idf"))


def tf_max_norm(spark, d):
    ones = st.sentences(documents(spark, d)).where("NOT is_sample")
    terms = ones.select("doc_id", "idx", F.explode(tx.tfidf_of_clean(F.col("clean_content"))).alias("term")).groupBy("doc_id", "idx", "term").agg(F.count("*").alias("n"))
    most = terms.groupBy("doc_id", "idx").agg(F.max("n").alias("most"))
    return terms.join(most, ["doc_id", "idx"]).select("doc_id", "idx", "term", F.round(F.col("n") / F.col("most"), 6).alias("tf"))


def tfidf_sparse(spark, d):
    index = _index(spark, d)
    return st.term_weights(index.where("NOT is_sample"), _vocab(spark, d)).select("doc_id", "idx", "term", F.round("weight", 6).alias("weight"))


def exact_match_pairs(spark, d):
    return m.exact_pairs(_index(spark, d))


def candidate_pairs(spark, d):
    pairs = materialised(spark, "candidate", f"{d}/documents.parquet", lambda: (x.select(*m.PAIR, "n", "shared") for x in _candidates(spark, d)), repr(CONFIG))
    return _of_copies(spark, d, pairs)


def candidate_min_overlap(spark, d):
    return _of_copies(spark, d, _pairs(spark, d))


def jaccard_pairs(spark, d):
    return _of_copies(spark, d, _compared(spark, d, sets=True).select(*m.PAIR, F.round("jaccard", 6).alias("jaccard")))


def winnowing_pairs(spark, d):
    return _of_copies(spark, d, _compared(spark, d, sets=True).select(*m.PAIR, F.round("winnowing", 6).alias("winnowing")))


def cosine_pairs(spark, d):
    return _of_copies(spark, d, _compared(spark, d).select(*m.PAIR, F.round("cosine", 6).alias("cosine")))


def weighted_score(spark, d):
    return _of_copies(spark, d, m.scored(_compared(spark, d), EngineConfig(threshold=0.3)).select(*m.PAIR, F.round("similarity", 6).alias("similarity")))


def sentence_matches(spark, d):
    return _matches(spark, d)[1].select(*m.PAIR, *[F.round(c, 6).alias(c) for c in ("similarity", "cosine", "winnowing", "jaccard")])


def passages_raw(spark, d):
    islands = materialised(spark, "island", f"{d}/documents.parquet", lambda: _islands(spark, d), repr(CONFIG))
    return islands.select("doc_id", "source_doc", "t_from", "t_to", "s_from", "s_to", "n", F.round("sim_avg", 6).alias("sim_avg"), F.round("sim_max", 6).alias("sim_max"))


def passages_final(spark, d):
    return _spans(spark, d)[1].select("doc_id", "source_doc", "t_from", "t_to", "s_from", "s_to", "n", F.round("sim_avg", 6).alias("sim_avg"), F.round("sim_max", 6).alias("sim_max"))


def doc_passage_count(spark, d):
    return sq.document_passages(_spans(spark, d)[1])


def patchworks_final(spark, d):
    return _spans(spark, d)[2].select("doc_id", "t_from", "t_to", "n", "n_sources")


def patchwork_sources(spark, d):
    rows = _spans(spark, d)[2].select("doc_id", "t_from", F.explode("detail").alias("x"))
    return rows.select("doc_id", "t_from", "x.source_doc", "x.s_from", "x.s_to", F.col("x.n").alias("n"))


def highlight_remainder(spark, d):
    return sq.remainder(*_spans(spark, d))


def match_kind(spark, d):
    return sq.match_kinds(*_spans(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def report_stats(spark, d):
    index, near = _index(spark, d), _near(spark, d)

    def build():
        for x in _shares(spark, d):
            yield stats.source_counts(m.met_sources(index.where(F.col("is_sample") | x), near.where(x)))

    counts = materialised(spark, "n_sources", f"{d}/documents.parquet", build, repr(CONFIG))
    return stats.report_stats(index, None, _matched(spark, d), counts)


def source_stats(spark, d):
    return stats.source_stats_of_copies(_index(spark, d), _near(spark, d))


def whole_copy(spark, d):
    return stats.whole_copies(source_stats(spark, d))


def spans_by_source(spark, d):
    _, found, patched = _spans(spark, d)
    return stats.spans_by_source(found, patched)


def unmatched_sentences(spark, d):
    index = _index(spark, d)
    return m.unmatched(index).select("doc_id", "idx", "content")


def source_view(spark, d):
    """For each submission and source: the matched source sentences, with the first submission sentence of each."""
    return m.first_of_places(_index(spark, d), _near(spark, d))


def containment_audit(spark, d):
    """For each document, benchmark items that its clean sentences, put together, hold as a whole."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", tx.clean_text(F.col("text")).alias("key")).where("key <> ''")
    # the first five words of an item, or all of a shorter one, are looked up as an equi-join before the substring test
    first = items.withColumn("gram", F.array_join(F.slice(F.split("key", " "), 1, 5), " "))
    sizes = [r[0] for r in first.select(F.size(F.split("gram", " "))).distinct().collect()]  # five numbers at most
    docs = documents(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("body"))
    of_sizes = F.concat(*[tx.kgrams(F.split("body", " "), k) for k in sizes]) if sizes else F.array().cast("array<string>")
    # what is looked for decides the way: sent to every task if its size is small, met in a shuffle if not
    small = first.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("gram")), F.lit(0))).first()[0] <= SENT_BYTES
    first = F.broadcast(first) if small else first
    grams = docs.select("doc_id", F.explode(F.array_distinct(of_sizes)).alias("gram"))
    hits = grams.join(first, "gram").join(docs, "doc_id").where(F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" "))))
    return hits.select("doc_id", "item_id").distinct()


def incremental_idf(spark, d):
    """Vocabulary of the samples, kept, and the new terms of the submissions taken in as samples."""
    index = _index(spark, d)
    known = _vocab(spark, d)
    n = documents(spark, d).select("doc_id").count()
    added = st.incremental_idf(known, index.where("NOT is_sample"), n)
    return known.union(added).select("term", "df", F.round("idf", 6).alias("idf"))


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def _goes_on(x: str) -> str:
    token = rf"regexp_extract({x}, '(?:^|\s)(\S*[^.!?\s])[.!?]+$', 1)"
    short = ", ".join(f"'{a}'" for a in ABBREVIATIONS)
    return (
        rf"(regexp_replace(lower({token}), '^[^\p{{L}}\d.]+', '') IN ({short}) OR regexp_matches({token}, '^\p{{Lu}}$')"
        rf" OR (regexp_matches({token}, '^\d+([.,]\d+)*$') AND length(regexp_replace({x}, '[.!?]+$', '')) < 15))"
    )


_CLEAN = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _eligible(x: str) -> str:
    return rf"(len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{N}}]*')) >= 2 AND {_CLEAN.format(x=x)} <> '')"


_SENT = rf"""
docs AS (SELECT doc_id, text, source NOT IN ('src0', 'src1') AS is_sample FROM documents),
para AS (SELECT doc_id, is_sample, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs),
cut AS (SELECT doc_id, is_sample, line_no, string_split(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '([.!?]+) ([\p{{Lu}}\d"''(\[«“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM para),
glued AS (SELECT doc_id, is_sample, line_no, list_filter(list_transform(string_split(array_to_string(list_transform(pieces, lambda x: x || CASE WHEN {_goes_on("x")} THEN ' ' ELSE chr(1) END), ''), chr(1)), lambda x: trim(x)), lambda x: x <> '' AND {_eligible("x")}) AS own FROM cut),
filled AS (SELECT doc_id, is_sample, line_no, own, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM glued WHERE len(own) > 0),
flat AS (SELECT doc_id, is_sample, para_no, unnest(own) AS content, generate_subscripts(own, 1) AS k FROM filled),
sent AS (SELECT doc_id, is_sample, 'DOAN_' || lpad(CAST(para_no AS VARCHAR), greatest(3, CAST(length(CAST(para_no AS VARCHAR)) AS INT)), '0') AS paragraph_id, content, {_CLEAN.format(x="content")} AS clean_content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_no, k) AS INTEGER) AS idx FROM flat)"""

_CONTENT = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]+$'))"
_TFIDF = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s_]', '', 'g'), '\s+'), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$'))"

_GRAMS = _SENT + r""",
gram AS (SELECT *, string_split(clean_content, ' ') AS words FROM sent),
hashed AS (SELECT *, list_transform(
  CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 2), lambda i: array_to_string(words[i:i + 2], ' ')) END,
  lambda g: list_reduce(list_transform(string_split(g, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 1000000007, CAST(0 AS BIGINT))) AS h FROM gram)"""

_INDEX = _GRAMS + rf""",
placed AS (SELECT *, CASE WHEN len(h) >= 4 THEN list_sort(list_distinct(list_transform(generate_series(1, len(h) - 3), lambda i: i + 4 - list_position(list_reverse(h[i:i + 3]), list_min(h[i:i + 3]))))) END AS places FROM hashed),
idx_t AS (SELECT doc_id, is_sample, idx, paragraph_id, content, clean_content, md5(clean_content) AS sentence_hash, len({_CONTENT.format(x="clean_content")}) AS token_count, list_distinct(words) AS words,
  CASE WHEN len(h) < 4 THEN [list_min(h)] ELSE list_transform(places, lambda p: h[p]) END AS fp FROM placed)"""

_IDF = rf""",
n_docs AS (SELECT count(DISTINCT doc_id) AS n FROM sent WHERE is_sample),
df_t AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TFIDF.format(x="clean_content")}) AS term FROM sent WHERE is_sample) GROUP BY term),
idf_t AS (SELECT term, df, greatest(0.0, log10(n / CAST(df AS DOUBLE))) AS idf FROM df_t, n_docs)"""

_TF = rf""",
tf_n AS (SELECT doc_id, idx, is_sample, term, count(*) AS n FROM (SELECT doc_id, idx, is_sample, unnest({_TFIDF.format(x="clean_content")}) AS term FROM sent) GROUP BY ALL),
tf_t AS (SELECT doc_id, idx, is_sample, term, n / CAST(max(n) OVER (PARTITION BY doc_id, idx) AS DOUBLE) AS tf FROM tf_n)"""

_W = _IDF + _TF + """,
w_t AS (SELECT doc_id, idx, is_sample, term, tf * idf AS weight FROM tf_t JOIN idf_t USING (term) WHERE idf > 0)"""

_EXACT = """,
sub AS (SELECT * FROM idx_t WHERE NOT is_sample AND token_count > 0),
sam AS (SELECT * FROM idx_t WHERE is_sample),
exact AS (SELECT a.doc_id, a.idx, b.doc_id AS source_doc, b.idx AS source_idx FROM sub a JOIN sam b ON a.sentence_hash = b.sentence_hash AND a.doc_id <> b.doc_id),
open_t AS (SELECT * FROM sub a WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = a.doc_id AND e.idx = a.idx))"""

_CAND = _EXACT + """,
lf AS (SELECT doc_id, idx, len(fp) AS n, unnest(list_distinct(fp)) AS f FROM open_t WHERE len(fp) >= 2),
rf AS (SELECT doc_id AS source_doc, idx AS source_idx, unnest(fp) AS f FROM sam),
cand AS (SELECT doc_id, idx, source_doc, source_idx, n, count(*) AS shared FROM lf JOIN rf USING (f) WHERE doc_id <> source_doc GROUP BY ALL),
over_t AS (SELECT * FROM cand WHERE shared >= greatest(2, floor(n * 0.2)))"""

_COMP = (
    _W
    + _CAND
    + """,
norm_t AS (SELECT doc_id, idx, sum(weight * weight) AS norm FROM w_t GROUP BY ALL),
dot_t AS (SELECT o.doc_id, o.idx, o.source_doc, o.source_idx, sum(a.weight * b.weight) AS dot FROM over_t o JOIN w_t a ON a.doc_id = o.doc_id AND a.idx = o.idx JOIN w_t b ON b.doc_id = o.source_doc AND b.idx = o.source_idx AND b.term = a.term GROUP BY ALL),
comp AS (SELECT o.doc_id, o.idx, o.source_doc, o.source_idx,
  coalesce(d.dot / (sqrt(na.norm) * sqrt(nb.norm)), 0.0) AS cosine,
  len(list_intersect(a.fp, b.fp)) / CAST(len(list_distinct(list_concat(a.fp, b.fp))) AS DOUBLE) AS winnowing,
  len(list_intersect(a.words, b.words)) / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE) AS jaccard
  FROM over_t o JOIN sub a ON a.doc_id = o.doc_id AND a.idx = o.idx JOIN sam b ON b.doc_id = o.source_doc AND b.idx = o.source_idx
  LEFT JOIN dot_t d ON d.doc_id = o.doc_id AND d.idx = o.idx AND d.source_doc = o.source_doc AND d.source_idx = o.source_idx
  LEFT JOIN norm_t na ON na.doc_id = o.doc_id AND na.idx = o.idx LEFT JOIN norm_t nb ON nb.doc_id = o.source_doc AND nb.idx = o.source_idx),
score AS (SELECT *, 0.4 * cosine + 0.4 * winnowing + 0.2 * jaccard AS similarity FROM comp WHERE cosine >= 0.25 AND winnowing >= 0.1)"""
)

_MATCH = _COMP + """,
hit AS (SELECT doc_id, idx, source_doc, source_idx, 1.0 AS similarity, 1.0 AS cosine, 1.0 AS winnowing, 1.0 AS jaccard FROM exact
  UNION ALL SELECT doc_id, idx, source_doc, source_idx, similarity, cosine, winnowing, jaccard FROM score WHERE similarity >= 0.6),
full_t AS (SELECT h.*, a.paragraph_id AS pa, b.paragraph_id AS pb FROM hit h JOIN sub a ON a.doc_id = h.doc_id AND a.idx = h.idx JOIN sam b ON b.doc_id = h.source_doc AND b.idx = h.source_idx)"""

_PASS = _MATCH + """,
lagged AS (SELECT *, lag(idx) OVER o AS i0, lag(source_idx) OVER o AS s0, lag(pa) OVER o AS pa0, lag(pb) OVER o AS pb0 FROM full_t WINDOW o AS (PARTITION BY doc_id, source_doc ORDER BY idx, source_idx)),
marked AS (SELECT *, sum(CASE WHEN idx = i0 + 1 AND source_idx = s0 + 1 AND pa = pa0 AND pb = pb0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, source_doc ORDER BY idx, source_idx) AS island FROM lagged),
pass AS (SELECT doc_id, source_doc, min(idx) AS t_from, max(idx) AS t_to, min(source_idx) AS s_from, max(source_idx) AS s_to, count(*) AS n, avg(similarity) AS sim_avg, max(similarity) AS sim_max FROM marked GROUP BY doc_id, source_doc, island HAVING count(*) >= 2)"""

_PATCH = _PASS + """,
cov AS (SELECT DISTINCT doc_id, CAST(unnest(generate_series(t_from, t_to)) AS INTEGER) AS idx FROM pass),
rest AS (SELECT * FROM full_t f WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.doc_id = f.doc_id AND c.idx = f.idx)),
prow AS (SELECT doc_id, idx, min(pa) AS pa FROM rest GROUP BY ALL),
plag AS (SELECT *, lag(idx) OVER o AS i0, lag(pa) OVER o AS pa0 FROM prow WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
pmark AS (SELECT doc_id, idx, sum(CASE WHEN idx = i0 + 1 AND pa = pa0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM plag),
psrc AS (SELECT r.doc_id, island, source_doc, source_idx, source_idx - lag(source_idx) OVER (PARTITION BY r.doc_id, island, source_doc ORDER BY source_idx) AS gap FROM rest r JOIN pmark USING (doc_id, idx)),
pdet AS (SELECT doc_id, island, source_doc, min(source_idx) AS s_from, max(source_idx) AS s_to, count(*) AS n, bool_or(coalesce(gap <> 1, false)) AS broken FROM psrc GROUP BY ALL),
pwhole AS (SELECT doc_id, island, min(idx) AS t_from, max(idx) AS t_to, count(*) AS n FROM pmark GROUP BY ALL HAVING count(*) >= 2),
pagg AS (SELECT doc_id, island, count(*) AS n_sources, bool_or(broken) AS broken FROM pdet GROUP BY ALL),
patch AS (SELECT w.*, n_sources FROM pwhole w JOIN pagg USING (doc_id, island) WHERE n_sources >= 2 OR broken)"""

_KINDS = _PATCH + """,
cov2 AS (SELECT DISTINCT doc_id, CAST(unnest(generate_series(t_from, t_to)) AS INTEGER) AS idx FROM patch),
one AS (SELECT DISTINCT doc_id, idx FROM hit),
kinds AS (SELECT o.doc_id, o.idx, CASE WHEN c.idx IS NOT NULL THEN 'passage' WHEN d.idx IS NOT NULL THEN 'patchwork' ELSE 'sentence' END AS kind
  FROM one o LEFT JOIN cov c USING (doc_id, idx) LEFT JOIN cov2 d USING (doc_id, idx))"""

_SSTAT = _MATCH + """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx, source_doc ORDER BY source_idx) AS k FROM hit) WHERE k = 1),
tot AS (SELECT doc_id, sum(token_count) AS n_words FROM sub GROUP BY doc_id),
sstat AS (SELECT f.doc_id, f.source_doc, count(*) AS n_sentences, CAST(sum(token_count) AS BIGINT) AS matched_words,
  least(100.0, greatest(0.0, floor(avg(cosine) * 100 + 0.5))) AS cosine_pct, least(100.0, greatest(0.0, floor(avg(jaccard) * 100 + 0.5))) AS jaccard_pct,
  least(100.0, greatest(0.0, floor(avg(winnowing) * 100 + 0.5))) AS winnowing_pct
  FROM firsts f JOIN sub s ON s.doc_id = f.doc_id AND s.idx = f.idx GROUP BY f.doc_id, f.source_doc),
sfull AS (SELECT sstat.*, CAST(n_words AS BIGINT) AS n_words, floor(matched_words / CAST(n_words AS DOUBLE) * 10000.0 + 0.5) / 100.0 AS coverage_pct FROM sstat JOIN tot USING (doc_id))"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_P = "doc_id, idx, source_doc, source_idx"
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("similarity", "cosine", "winnowing", "jaccard"))
_PASS_COLS = "doc_id, source_doc, t_from, t_to, s_from, s_to, n, round(sim_avg, 6) AS sim_avg, round(sim_max, 6) AS sim_max"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentences, paragraph_ids, content_tokens, tfidf_tokens, syllable_filter, md5_sentence, poly_hash_kgrams, winnow_fingerprints, vocab_idf,
        tf_max_norm, tfidf_sparse, exact_match_pairs, candidate_pairs, candidate_min_overlap, jaccard_pairs, winnowing_pairs, cosine_pairs,
        weighted_score, sentence_matches, passages_raw, passages_final, doc_passage_count, patchworks_final, patchwork_sources, highlight_remainder,
        match_kind, report_stats, source_stats, whole_copy, spans_by_source, unmatched_sentences, source_view, containment_audit, incremental_idf,
    )
}

ORACLES: dict[str, str] = {
    "sentences": _with(_SENT, "SELECT doc_id, idx, paragraph_id, content FROM sent"),
    "paragraph_ids": _with(_SENT, "SELECT doc_id, paragraph_id, count(*) AS n_sentences FROM sent GROUP BY ALL"),
    "content_tokens": _with(_SENT, f"SELECT doc_id, idx, len({_CONTENT.format(x='content')}) AS token_count, array_to_string({_CONTENT.format(x='content')}, ' ') AS tokens FROM sent"),
    "tfidf_tokens": _with(_SENT, f"SELECT doc_id, idx, array_to_string({_TFIDF.format(x='content')}, ' ') AS tokens FROM sent"),
    "syllable_filter": rf"SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{N}}]*'))) AS BIGINT) AS n_syllables, count(*) FILTER (WHERE {_eligible('line')}) AS n_eligible FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
    "md5_sentence": _with(_SENT, "SELECT doc_id, idx, md5(clean_content) AS sentence_hash FROM sent"),
    "poly_hash_kgrams": _with(_GRAMS, "SELECT doc_id, idx, array_to_string(h, ',') AS hashes FROM hashed"),
    "winnow_fingerprints": _with(_INDEX, "SELECT doc_id, idx, len(fp) AS n, array_to_string(fp, ',') AS fingerprints FROM idx_t"),
    "vocab_idf": _with(_SENT + _IDF, "SELECT term, df, round(idf, 6) AS idf FROM idf_t"),
    "tf_max_norm": _with(_SENT + _TF, "SELECT doc_id, idx, term, round(tf, 6) AS tf FROM tf_t WHERE NOT is_sample"),
    "tfidf_sparse": _with(_SENT + _W, "SELECT doc_id, idx, term, round(weight, 6) AS weight FROM w_t WHERE NOT is_sample"),
    "exact_match_pairs": _with(_INDEX + _EXACT, f"SELECT {_P} FROM exact"),
    "candidate_pairs": _with(_INDEX + _CAND, f"SELECT {_P}, n, shared FROM cand"),
    "candidate_min_overlap": _with(_INDEX + _CAND, f"SELECT {_P} FROM over_t"),
    "jaccard_pairs": _with(_INDEX + _COMP, f"SELECT {_P}, round(jaccard, 6) AS jaccard FROM comp"),
    "winnowing_pairs": _with(_INDEX + _COMP, f"SELECT {_P}, round(winnowing, 6) AS winnowing FROM comp"),
    "cosine_pairs": _with(_INDEX + _COMP, f"SELECT {_P}, round(cosine, 6) AS cosine FROM comp"),
    "weighted_score": _with(_INDEX + _COMP, f"SELECT {_P}, round(similarity, 6) AS similarity FROM score WHERE similarity >= 0.3"),
    "sentence_matches": _with(_INDEX + _MATCH, f"SELECT {_P}, {_R6} FROM hit"),
    "passages_raw": _with(_INDEX + _PASS, f"SELECT {_PASS_COLS} FROM pass"),
    # no overlap within a source arises on these tables; overlaps are tested on made rows
    "passages_final": _with(_INDEX + _PASS, f"SELECT {_PASS_COLS} FROM pass"),
    "patchworks_final": _with(_INDEX + _PATCH, "SELECT doc_id, t_from, t_to, n, n_sources FROM patch"),
    "patchwork_sources": _with(_INDEX + _PATCH, "SELECT p.doc_id, t_from, source_doc, s_from, s_to, d.n FROM patch p JOIN pdet d USING (doc_id, island)"),
    "highlight_remainder": _with(_INDEX + _KINDS, "SELECT doc_id, idx FROM kinds WHERE kind = 'sentence'"),
    "match_kind": _with(_INDEX + _KINDS, "SELECT doc_id, kind, count(*) AS n FROM kinds GROUP BY ALL"),
    "report_stats": _with(
        _INDEX + _MATCH,
        """SELECT s.doc_id, count(*) AS n_sentences, CAST(sum(token_count) AS BIGINT) AS n_words, count(o.idx) AS matched_sentences,
  CAST(coalesce(sum(CASE WHEN o.idx IS NOT NULL THEN token_count END), 0) AS BIGINT) AS matched_words, coalesce(any_value(ns.n), 0) AS n_sources,
  floor(100.0 * coalesce(sum(CASE WHEN o.idx IS NOT NULL THEN token_count END), 0) / CAST(sum(token_count) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS overlap_pct
FROM sub s LEFT JOIN (SELECT DISTINCT doc_id, idx FROM hit) o ON o.doc_id = s.doc_id AND o.idx = s.idx
LEFT JOIN (SELECT doc_id, count(DISTINCT source_doc) AS n FROM hit GROUP BY doc_id) ns ON ns.doc_id = s.doc_id GROUP BY s.doc_id""",
    ),
    "source_stats": _with(_INDEX + _SSTAT, "SELECT doc_id, source_doc, n_sentences, matched_words, cosine_pct, jaccard_pct, winnowing_pct, n_words, coverage_pct FROM sfull"),
    "whole_copy": _with(_INDEX + _SSTAT, "SELECT doc_id, source_doc, matched_words, coverage_pct FROM sfull WHERE coverage_pct >= 80.0"),
    "spans_by_source": _with(
        _INDEX + _PATCH,
        """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.source_doc, b.source_doc) AS source_doc, coalesce(a.n, 0) AS n_passages, coalesce(b.n, 0) AS n_patchworks
FROM (SELECT doc_id, source_doc, count(*) AS n FROM pass GROUP BY ALL) a FULL JOIN (SELECT p.doc_id, source_doc, count(*) AS n FROM patch p JOIN pdet d USING (doc_id, island) GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.source_doc = b.source_doc""",
    ),
    "unmatched_sentences": _with(_INDEX + _EXACT, "SELECT doc_id, idx, content FROM open_t"),
    "source_view": _with(_INDEX + _MATCH, "SELECT doc_id, source_doc, source_idx, min(idx) AS idx FROM hit GROUP BY ALL"),
    "containment_audit": f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(' ' || {_CLEAN.format(x='d.text')} || ' ', ' ' || {_CLEAN.format(x='b.text')} || ' ') WHERE {_CLEAN.format(x='b.text')} <> ''",
    "incremental_idf": _with(
        _SENT + _IDF,
        f"""SELECT term, df, round(idf, 6) AS idf FROM idf_t UNION ALL
SELECT term, df, round(greatest(0.0, log10((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 6) AS idf FROM
(SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TFIDF.format(x="clean_content")}) AS term FROM sent WHERE NOT is_sample) GROUP BY term) WHERE term NOT IN (SELECT term FROM df_t)""",
    ),
}
