"""What users look things up with: searches, marks, selections of pages, rankings, audits, comparison of two texts. With DuckDB SQL written from the rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import matching as m
from ..operators import regions as rg
from ..operators import statistics as stats
from ..sources.lines import text_lines
from ..sources.storage import workbook
from . import layout, overlap, records
from . import structure as struct
from .records import _table

#: what is looked for
KEYWORD, SEARCHED = "the", "30/01"
#: admitted kinds of files and their largest size in bytes
KINDS, LARGEST = ("html", "htm", "txt", ""), 20 * 1024


def code_search(spark, d):
    """Codes that begin as a pattern says: zeros, then one to three figures."""
    return _table(spark, d, "customer").where(F.col("c_name").rlike("^Customer#0+[1-9][0-9]{0,2}$")).select("c_custkey", "c_name")


def report_search(spark, d):
    """Reports whose id, title or date of the last check (as shown) holds the text, whatever its case."""
    shown = records._state(spark, d).select("report", F.lower("title").alias("title"), F.coalesce(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit("--")).alias("date"))
    held = lambda c: F.contains(F.col(c).cast("string"), F.lit(SEARCHED.lower()))
    return shown.where(held("report") | held("title") | held("date")).select("report", "date")


def keyword_marks(spark, d):
    """Every occurrence of a word marked, whatever its case, in all documents."""
    marked = tx.mark_keyword(F.col("text"), KEYWORD)
    return _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", ((F.length(marked) - F.length("text")) / len("<mark></mark>")).cast("int").alias("n_marks"), F.md5(marked).alias("marked_md5"))


def page_admission(spark, d):
    """Which pages are taken in: by the extension of their file and their size."""
    ext = records.file_names(spark, d).select("page_id", "ext")
    size = _table(spark, d, "pages").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("n_bytes"))
    why = F.when(~F.col("ext").isin(*KINDS), "kind").when(F.col("n_bytes") == 0, "empty").when(F.col("n_bytes") > LARGEST, "size").otherwise("admitted")
    return ext.join(size, "page_id").select("page_id", "ext", "n_bytes", why.alias("outcome"))


def page_selection(spark, d):
    """The pages that a written selection means, of each printed document: one number alone means from there on."""
    n = layout._pages(spark, d).select("doc_id", F.ceil(F.size("lines") / (layout.PAGE_LINES + 2)).cast("int").alias("n_pages"))
    k = F.col("doc_id") % 5
    spec = F.when(k == 0, "2").when(k == 1, "1-2, 4").when(k == 2, "5-3;1").when(k == 3, "x, 2, 900").otherwise("3–4")
    return n.select("doc_id", "n_pages", F.array_join(tx.parse_page_range(spec, F.col("n_pages")).cast("array<string>"), ",").alias("pages"))


def line_lengths(spark, d):
    """Median and ninth decile of the line lengths of each document, as values that occur."""
    lengths = F.transform(text_lines(F.col("text")), lambda x: F.length(x))
    return _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.floor_percentile(lengths, 0.5).alias("median"), tx.floor_percentile(lengths, 0.9).alias("ninth_decile"))


def top3_sources(spark, d):
    """The three sources of each submission that cover most of it, with their titles; a source without one has an empty title."""
    ranked = overlap.source_stats(spark, d).select("doc_id", "source_doc", "coverage_pct")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("coverage_pct"), "source_doc"))
    best = ranked.withColumn("place", place).where("place <= 3")
    titles = _table(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("source_doc"), F.substring(F.split("text", "\n")[0], 1, 30).alias("title"))
    return best.join(titles, "source_doc", "left").select("doc_id", "place", "source_doc", "coverage_pct", F.coalesce("title", F.lit("")).alias("title"))


def exact_match_classes(spark, d):
    """Equal sentences by their hash, a row each: how often in submissions and in samples, and how many pairs of different documents."""
    index = overlap._index(spark, d)
    own = m.submissions(index).groupBy("sentence_hash", "doc_id").agg(F.count("*").alias("a"))
    side = own.groupBy("sentence_hash").agg(F.sum("a").alias("n_submission"), F.count("*").alias("n_submissions"))
    samples = index.where("is_sample").groupBy("sentence_hash").agg(F.count("*").alias("n_sample"), F.countDistinct("doc_id").alias("n_samples"))
    # no document is a submission and a sample, so all pairs are of different documents
    return side.join(samples, "sentence_hash").select(F.lower(F.hex("sentence_hash")).alias("sentence_hash"), "n_submission", "n_submissions", "n_sample", "n_samples", (F.col("n_submission") * F.col("n_sample")).alias("n_pairs"))


def audit_totals(spark, d):
    """Sentences that the compared text of a document lacks against its whole text, and the other way round, by hash."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit(True).alias("is_sample"), text_lines(F.col("text")).alias("lines"))
    compared = rg.with_regions(docs).select("doc_id", "is_sample", F.array_join(F.transform("compared", lambda i: F.element_at("lines", i)), "\n").alias("text"))
    whole = docs.select("doc_id", "is_sample", F.array_join("lines", "\n").alias("text"))
    counted = lambda rows, n: overlap.st.sentences(rows).select("doc_id", F.md5("clean_content").alias("h")).groupBy("doc_id", "h").agg(F.count("*").alias(n))
    both = counted(compared, "kept").join(counted(whole, "found"), ["doc_id", "h"], "full").fillna(0, ["kept", "found"])
    above = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))).cast("long")
    return both.groupBy("doc_id").agg(F.sum("kept").alias("n_kept"), F.sum("found").alias("n_found"), above("found", "kept").alias("n_missing"), above("kept", "found").alias("n_extra"))


def text_pair_winnowing(spark, d):
    """Similarity of each text and the next by their fingerprints, with runs of five words and windows of four."""
    prints = F.array_distinct(tx.fingerprints(tx.kgram_hashes(tx.words(F.col("text")), 5), 4))
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", prints.alias("fp_a"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fp_a").alias("fp_b"))
    return docs.join(following, "doc_id").select("doc_id", F.size("fp_a").alias("n"), F.round(sim.SIMILARITIES["winnowing"](), 6).alias("similarity"))


def compared_lines(spark, d):
    """How much of each document is compared: its lines by region and the words of the compared ones."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text_lines(F.col("text")).alias("lines"))
    n = lambda r: F.size(F.filter("regions", lambda x: x == r)).alias(f"n_{r}")
    words = F.aggregate(F.transform("compared", lambda i: tx.syllables(ln.without_labels(F.element_at("lines", i)))), F.lit(0), lambda a, x: a + x)
    return rg.with_regions(docs).select("doc_id", n("cover"), n("skipped"), n("body"), F.size("compared").alias("n_compared"), words.alias("n_words"))


def _ratings(spark, d):
    return _table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts", (F.col("event_id") % 5 + 1).cast("int").alias("stars"))


def rating_shares(spark, d):
    """How many ratings have five to one stars, none left out, and their share in percent with one decimal."""
    n = _ratings(spark, d).groupBy("stars").agg(F.count("*").alias("n"))
    every = spark.range(1, 6).select(F.col("id").cast("int").alias("stars")).join(F.broadcast(n), "stars", "left").fillna(0, ["n"])
    return every.select("stars", "n", records.percent_text(100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))).alias("shown"))


def rating_means(spark, d):
    """Mean stars of each reviewer with one decimal, and how many ratings they gave; sums are whole numbers."""
    sums = _ratings(spark, d).groupBy("user_id").agg(F.sum("stars").alias("s"), F.count("*").alias("n"))
    return sums.select("user_id", "n", F.expr("(10 * s + n div 2) div n").alias("tenths"), F.format_string("%.1f", F.expr("(10 * s + n div 2) div n") / 10).alias("shown"))


def ratings_workbook(spark, d):
    """Lines of a workbook: the list of ratings and their distribution."""
    listed = _ratings(spark, d).select("event_id", "user_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("at"), "stars")
    return workbook([("Ratings", listed, ["event_id"]), ("Distribution", rating_shares(spark, d).withColumn("less", -F.col("stars")).select("less", "stars", "n", "shown"), ["less"])])


def accounts_workbook(spark, d):
    """Lines of a workbook with a sheet for students, teachers and those who are both, and how many reports each has."""
    n = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_reports"))
    students = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    teachers = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("teacher"))
    all_ = students.join(teachers, "id", "full").join(n, "id", "left").fillna(0, ["n_reports"])
    return workbook([
        ("Students", all_.where("teacher IS NULL").select("id", "name", "n_reports"), ["id"]), ("Teachers", all_.where("name IS NULL").select("id", "teacher", "n_reports"), ["id"]),
        ("Both", all_.where("name IS NOT NULL AND teacher IS NOT NULL").select("id", "name", "teacher", "n_reports"), ["id"]),
    ])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (code_search, report_search, keyword_marks, page_admission, page_selection, line_lengths, top3_sources, exact_match_classes, audit_totals, text_pair_winnowing, compared_lines, rating_shares, rating_means, ratings_workbook, accounts_workbook)
}

_FILE = f"({records.ORACLES['file_names']})"
_GRAMS5 = r"""
word_t AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s_]', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
hash_t AS (SELECT doc_id, list_transform(
  CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END,
  lambda g: list_reduce(list_transform(string_split(g, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 1000000007, CAST(0 AS BIGINT))) AS h FROM word_t),
print_t AS (SELECT doc_id, list_distinct(CASE WHEN len(h) = 0 THEN [] WHEN len(h) < 4 THEN [list_min(h)] ELSE list_transform(generate_series(1, len(h) - 3), lambda i: list_min(h[i:i + 3])) END) AS fp FROM hash_t)"""

_MARKED = struct._LINES + struct._regions("arrays")
_TEXTS = f""",
raw_l AS (SELECT kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM arrays WHERE kind = 'document'),
kept_d AS (SELECT r.id AS doc_id, string_agg(r.line, chr(10) ORDER BY r.line_no) AS text, 'src9' AS source FROM raw_l r JOIN placed USING (kind, id, line_no) JOIN marks USING (kind, id) WHERE {struct._COMPARED} GROUP BY r.id),
full_d AS (SELECT id AS doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, 'src9' AS source FROM raw_l GROUP BY id),"""


def _sentences_of(table: str, mark: str) -> str:
    """The sentences of another table, under names of their own."""
    return re.sub(r"\b(docs|para|cut|glued|filled|flat|sent)\b", rf"\1_{mark}", overlap._SENT.strip()).replace("FROM documents", f"FROM {table}")


ORACLES: dict[str, str] = {
    "compared_lines": _MARKED + f""" SELECT id AS doc_id, CAST(count_if(region = 'cover') AS INTEGER) AS n_cover, CAST(count_if(region = 'skipped') AS INTEGER) AS n_skipped, CAST(count_if(region = 'body') AS INTEGER) AS n_body,
  CAST(count_if({struct._COMPARED}) AS INTEGER) AS n_compared, CAST(coalesce(sum(CASE WHEN {struct._COMPARED} THEN len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]*\\p{{L}}[\\p{{L}}\\p{{N}}]*')) END), 0) AS INTEGER) AS n_words
FROM placed JOIN marks USING (kind, id) JOIN told USING (kind, id, line_no) WHERE kind = 'document' GROUP BY id""",
    "audit_totals": _MARKED + _TEXTS + _sentences_of("kept_d", "k") + ", " + _sentences_of("full_d", "f") + """,
a AS (SELECT doc_id, md5(clean_content) AS h, count(*) AS kept FROM sent_k GROUP BY ALL), b AS (SELECT doc_id, md5(clean_content) AS h, count(*) AS found FROM sent_f GROUP BY ALL)
SELECT doc_id, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS n_kept, CAST(sum(coalesce(found, 0)) AS BIGINT) AS n_found, CAST(sum(greatest(coalesce(found, 0) - coalesce(kept, 0), 0)) AS BIGINT) AS n_missing,
  CAST(sum(greatest(coalesce(kept, 0) - coalesce(found, 0), 0)) AS BIGINT) AS n_extra FROM a FULL JOIN b USING (doc_id, h) GROUP BY doc_id""",
    "code_search": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#%' AND CAST(substr(c_name, 10) AS BIGINT) BETWEEN 1 AND 999 AND substr(c_name, 10, 1) = '0'",
    "report_search": f"WITH {records._STATES} SELECT report, coalesce(strftime(ts, '%d/%m/%Y %H:%M'), '--') AS date FROM states WHERE contains(CAST(report AS VARCHAR) || chr(10) || lower(title) || chr(10) || coalesce(strftime(ts, '%d/%m/%Y %H:%M'), '--'), '30/01')",
    "keyword_marks": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS n_marks, md5(regexp_replace(text, '(?i)the', '<mark>\0</mark>', 'g')) AS marked_md5 FROM documents WHERE text IS NOT NULL",
    "page_admission": f"SELECT page_id, ext, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, CASE WHEN ext NOT IN ('html', 'htm', 'txt', '') THEN 'kind' WHEN coalesce(html, '') = '' THEN 'empty' WHEN strlen(html) > 20480 THEN 'size' ELSE 'admitted' END AS outcome FROM {_FILE} JOIN pages USING (page_id)",
    "page_selection": rf"""WITH n AS (SELECT doc_id, CAST((len(l) + 2 * ((len(l) + 19) // 20) + 21) // 22 AS INTEGER) AS n_pages FROM (SELECT doc_id, {records._BROKEN} AS l FROM documents WHERE text IS NOT NULL)),
page AS (SELECT doc_id, n_pages, unnest(range(1, n_pages + 1)) AS p FROM n),
hit AS (SELECT doc_id, p FROM page WHERE CASE doc_id % 5 WHEN 0 THEN p >= 2 WHEN 1 THEN p IN (1, 2, 4) WHEN 2 THEN p IN (1, 3, 4, 5) WHEN 3 THEN p IN (2, 900) ELSE p IN (3, 4) END)
SELECT n.doc_id, n_pages, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') AS pages FROM n LEFT JOIN hit USING (doc_id) GROUP BY n.doc_id, n_pages""",
    "line_lengths": r"""WITH l AS (SELECT doc_id, list_sort(list_transform(string_split_regex(text, '\r?\n'), lambda x: length(x))) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(s[CAST(floor(0.5 * (len(s) - 1)) AS BIGINT) + 1] AS INTEGER) AS median, CAST(s[CAST(floor(0.9 * (len(s) - 1)) AS BIGINT) + 1] AS INTEGER) AS ninth_decile FROM l""",
    "top3_sources": overlap._with(overlap._INDEX + overlap._SSTAT, """SELECT r.doc_id, CAST(place AS INTEGER) AS place, source_doc, coverage_pct, CASE WHEN source_doc % 3 > 0 THEN coalesce(substr(string_split(d.text, chr(10))[1], 1, 30), '') ELSE '' END AS title
FROM (SELECT doc_id, source_doc, coverage_pct, row_number() OVER (PARTITION BY doc_id ORDER BY coverage_pct DESC, source_doc) AS place FROM sfull) r LEFT JOIN documents d ON d.doc_id = source_doc WHERE place <= 3"""),
    "exact_match_classes": overlap._with(overlap._INDEX + overlap._EXACT, """SELECT a.sentence_hash, CAST(na AS BIGINT) AS n_submission, da AS n_submissions, nb AS n_sample, db AS n_samples, CAST(na * nb AS BIGINT) AS n_pairs
FROM (SELECT sentence_hash, count(*) AS na, count(DISTINCT doc_id) AS da FROM sub GROUP BY 1) a JOIN (SELECT sentence_hash, count(*) AS nb, count(DISTINCT doc_id) AS db FROM sam GROUP BY 1) b USING (sentence_hash)"""),
    "rating_shares": r"""WITH r AS (SELECT 1 + event_id % 5 AS stars FROM events WHERE event_type = 'click'), n AS (SELECT CAST(b.stars AS INTEGER) AS stars, count(r.stars) AS n FROM (VALUES (1), (2), (3), (4), (5)) b(stars) LEFT JOIN r ON r.stars = b.stars GROUP BY b.stars)
SELECT stars, n, CASE WHEN (SELECT count(*) FROM r) = 0 THEN '0%' ELSE regexp_replace(printf('%.1f', floor(1000.0 * n / (SELECT count(*) FROM r) + 0.5) / 10), '\.0$', '') || '%' END AS shown FROM n""",
    "rating_means": """WITH r AS (SELECT user_id, count(*) AS n, (10 * sum(1 + event_id % 5) + count(*) // 2) // count(*) AS tenths FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, n, CAST(tenths AS BIGINT) AS tenths, printf('%.1f', tenths / 10.0) AS shown FROM r""",
    "text_pair_winnowing": f"WITH {_GRAMS5} SELECT a.doc_id, CAST(len(a.fp) AS INTEGER) AS n, round(CASE WHEN len(list_distinct(list_concat(a.fp, b.fp))) = 0 THEN 0.0 ELSE len(list_intersect(a.fp, b.fp)) / CAST(len(list_distinct(list_concat(a.fp, b.fp))) AS DOUBLE) END, 6) AS similarity FROM print_t a JOIN print_t b ON b.doc_id = a.doc_id + 1",
}
