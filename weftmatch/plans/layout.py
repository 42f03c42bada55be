"""Queries on words, marked spans, printed pages and order: segmentation, pieces of spans, running headers, places of sentences, collation.

The SQL beside them is written from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boxes as bx
from ..operators import headers as hd
from ..operators import locating as lo
from ..operators import paragraphs as pg
from ..operators import segmentation as sg
from ..operators import spans as sp
from . import overlap
from . import structure as struct

#: phrases stand in a fiftieth of all documents, stop words in four tenths
PHRASE_SHARE, STOP_PERCENT = 50, 40
#: a page has 20 lines, with its header and number before them
PAGE_LINES = 20


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def segmented_tokens(spark, d):
    docs = _documents(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), sg.plain_words(F.col("line")).alias("words"))
    known = sg.learnt_phrases(docs, F.split("text", "\n"), max(2, docs.count() // PHRASE_SHARE))
    found = sg.segmented(rows, "words", known)
    return found.select("doc_id", "line_no", F.size("segments").alias("n_tokens"), F.md5(F.array_join("segments", " ")).alias("tokens_md5"))


def content_tokens_stopped(spark, d):
    docs = _documents(spark, d)
    stop = [r[0] for r in sg.frequent_words(docs, "doc_id", "text", STOP_PERCENT).collect()]  # some hundreds: see frequent_words
    kept = tx.content_tokens(F.col("text"), stop)
    return docs.where("text IS NOT NULL").select("doc_id", F.size(tx.content_tokens(F.col("text"))).alias("n_words"), F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, " ")).alias("kept_md5"))


def elementary_spans(spark, d):
    """Passages and patchworks of each submission, cut at every edge; a row for each piece and source."""
    _, passages, patchworks = overlap._spans(spark, d)
    parts = patchworks.select("doc_id", "t_from", "t_to", F.explode("detail").alias("x")).select("doc_id", "t_from", "t_to", "x.source_doc")
    return sp.elementary(passages.select("doc_id", "t_from", "t_to", "source_doc").union(parts), "doc_id", "t_from", "t_to", "source_doc")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts as on printed pages: broken into lines, with a header and a page number before every twentieth."""
    broken = _documents(spark, d).where("text IS NOT NULL").select("doc_id", F.split(F.regexp_replace("text", struct.WIDTH, "$1\n"), "\n").alias("raw"))
    header = F.concat(F.lit("Report of "), F.regexp_replace(F.substring(F.element_at("raw", 1), 1, 30), r"[.!?:;\s]+$", ""))
    page = lambda x, i: F.when(i % PAGE_LINES == 0, F.array(header, (F.floor(i / PAGE_LINES) + 1).cast("string"), x)).otherwise(F.array(x))
    return broken.select("doc_id", F.flatten(F.transform("raw", page)).alias("lines"))


def running_header_removal(spark, d):
    found = hd.join_widths(hd.without_page_marks(_pages(spark, d), "lines", "kept"), "kept", "joined")
    return found.select("doc_id", F.size("lines").alias("n_lines"), F.size("kept").alias("n_kept"), F.size("joined").alias("n_joined"), F.md5(F.array_join("joined", "\n")).alias("text_md5"))


def located_sentences(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    return lo.locate(_documents(spark, d), items).withColumn("score", F.round("score", 6))


def collated_titles(spark, d):
    """Titles in Vietnamese order, case and tones aside, whole class by class; documents without one come last in both directions."""
    line = F.regexp_replace(F.substring(F.split("text", "\n")[0], 1, 40), r"[^\p{L} ]", "")
    titled = _documents(spark, d).select("doc_id", "lang", "source", F.nullif(F.trim(F.when(F.col("doc_id") % 17 > 0, line)), F.lit("")).alias("title"))
    ordered = titled.withColumn("key", F.collate(F.col("title"), "vi_CI_AI"))
    place = lambda order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(order("key"), "doc_id")).alias
    return ordered.select("lang", "source", "doc_id", "title", place(F.asc_nulls_last)("up"), place(F.desc_nulls_last)("down"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each word of the printed texts: 40 lines a page, five points a letter, uneven by place as scanned pages are."""
    lines = _documents(spark, d).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", struct.WIDTH, "$1\n"), "\n")).alias("i", "line"))
    words = lines.select("doc_id", "i", F.posexplode(F.split("line", " ")).alias("w", "word"), "line")
    before = F.length(F.array_join(F.slice(F.split("line", " "), 1, F.col("w")), " ")) + F.when(F.col("w") > 0, 1).otherwise(0)
    placed = words.where("word <> ''").withColumn("x", 5.0 * before).withColumn("y", 14.0 * (F.col("i") % 40) + F.col("w") % 3)
    return placed.select("doc_id", (F.floor(F.col("i") / 40) + 1).cast("int").alias("page"), (F.col("i") * 10000 + F.col("w")).alias("place"), "x", "y", (5.0 * F.length("word")).alias("width"), (10.0 + F.col("w") % 2).alias("height"))


def points_in_tables(spark, d):
    """Words within the ruled tables of each page (one a page, placed by document), with tolerance."""
    boxes = _boxes(spark, d)
    top = 14.0 * ((F.col("doc_id") + F.col("page")) % 30)
    tables = boxes.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(20.0).alias("x0"), top.alias("y0"), F.lit(230.0).alias("x1"), (top + 70.0).alias("y1"))
    found = bx.inside(boxes.select("doc_id", "page", "place", "x", "y"), tables, ["doc_id", "page"])
    return found.groupBy("doc_id", "page").agg(F.count("*").alias("n_inside"), F.sum("place").alias("places"))


def box_lines(spark, d):
    """Lines of each page by the height of their boxes, without headers and footers."""
    boxes = _boxes(spark, d)
    heights = boxes.select("doc_id", "page").distinct().withColumn("page_height", F.lit(560.0))
    kept = bx.without_bands(boxes, heights, ["doc_id", "page"])
    return bx.lines_of_boxes(kept, ["doc_id", "page"]).select("doc_id", "page", "line", "y", "x_from", "x_to", "height", "n")


def layout_paragraphs(spark, d):
    """Paragraphs of printed pages: each line of a text is a paragraph, broken to a page's width with its first line indented, 40 lines a page
    under a header; what is rebuilt is compared with the text."""
    docs = _documents(spark, d).where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("own"))
    broken = F.flatten(F.transform("own", lambda p: F.transform(F.split(F.regexp_replace(F.trim(p), struct.WIDTH, "$1\n"), "\n"), lambda t, k: F.struct(t.alias("text"), (k == 0).alias("first")))))
    lines = docs.withColumn("b", F.filter(broken, lambda r: r["text"] != ""))
    height = 14.0 * 44
    x0 = lambda r: F.when(r["first"], 92.0).otherwise(72.0)
    # set in full width: a line that is broken ends at the right edge
    def placed(r: Column, i: Column) -> Column:
        goes_on = ~F.coalesce(F.get(F.col("b"), i + 1)["first"], F.lit(True))
        x1 = F.when(goes_on, 472.0).otherwise(F.least(F.lit(472.0), x0(r) + 5.0 * F.length(r["text"])))
        return F.struct((F.floor(i / 40) + 1).cast("int").alias("page"), F.lit(height).alias("page_height"), (height - 14.0 * 2 - 14.0 * (i % 40)).alias("y"), x0(r).alias("x0"), x1.alias("x1"), r["text"].alias("text"), F.lit(False).alias("in_table"))

    head = lambda i: F.struct((F.floor(i / 40) + 1).cast("int").alias("page"), F.lit(height).alias("page_height"), F.lit(height - 5.0).alias("y"), F.lit(72.0).alias("x0"), F.lit(172.0).alias("x1"), F.concat(F.lit("page head "), (F.floor(i / 40) + 1).cast("string")).alias("text"), F.lit(False).alias("in_table"))
    pages = lines.withColumn("lines", F.flatten(F.transform("b", lambda r, i: F.when(i % 40 == 0, F.array(head(i), placed(r, i))).otherwise(F.array(placed(r, i))))))
    found = pg.rebuilt(pages.select("doc_id", "lines"), "lines")
    heads = F.filter("paragraphs", lambda t: t.rlike("^page head [0-9]+$"))
    rest = F.filter("paragraphs", lambda t: ~t.rlike("^page head [0-9]+$"))
    return found.select("doc_id", F.size(heads).alias("n_heads"), F.size(rest).alias("n_paragraphs"), F.md5(F.array_join(rest, "\n")).alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (segmented_tokens, content_tokens_stopped, elementary_spans, running_header_removal, located_sentences, collated_titles, points_in_tables, box_lines, layout_paragraphs)
}

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_SEGMENTED = rf"""
WITH RECURSIVE line AS (SELECT doc_id, line_no, {_WORDS.format(x='line')} AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
run AS (SELECT doc_id, line_no, i, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, line_no, words, unnest(range(1, len(words) + 1)) AS i FROM line), (VALUES (2), (3), (4)) AS ks(k) WHERE i + k - 1 <= len(words)),
known AS (SELECT phrase FROM run GROUP BY phrase HAVING count(DISTINCT doc_id) >= greatest(2, (SELECT count(*) FROM documents) // 50)),
longest AS (SELECT doc_id, line_no, i, max(k) AS k FROM run JOIN known USING (phrase) GROUP BY ALL),
spot AS (SELECT line.doc_id, line.line_no, p.i, coalesce(longest.k, 1) AS k, words FROM line, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) p LEFT JOIN longest ON longest.doc_id = line.doc_id AND longest.line_no = line.line_no AND longest.i = p.i),
walk AS (SELECT doc_id, line_no, i, k FROM spot WHERE i = 1 UNION ALL SELECT a.doc_id, a.line_no, a.i, a.k FROM walk w JOIN spot a ON a.doc_id = w.doc_id AND a.line_no = w.line_no AND a.i = w.i + w.k),
said AS (SELECT doc_id, line_no, count(*) AS n, string_agg(array_to_string(a.words[i:i + k - 1], '_'), ' ' ORDER BY i) AS tokens FROM walk JOIN spot a USING (doc_id, line_no, i, k) GROUP BY doc_id, line_no)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, md5(coalesce(tokens, '')) AS tokens_md5 FROM line LEFT JOIN said USING (doc_id, line_no)
"""
_STOPPED = rf"""
WITH stop AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest({_WORDS.format(x='text')}) AS word FROM documents) GROUP BY word HAVING count(*) * 100 >= 40 * (SELECT count(*) FROM documents)),
own AS (SELECT doc_id, list_filter({_WORDS.format(x='text')}, lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$')) AS words FROM documents WHERE text IS NOT NULL),
stops AS (SELECT list(word) AS stops FROM stop),
kept AS (SELECT doc_id, words, list_filter(words, lambda w: NOT list_contains(stops, w)) AS kept FROM own, stops)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(len(kept) AS INTEGER) AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5 FROM kept
"""
_PIECES = """,
marked_t AS (SELECT DISTINCT doc_id, t_from AS lo, t_to + 1 AS hi, source_doc FROM (SELECT doc_id, t_from, t_to, source_doc FROM pass
  UNION ALL SELECT p.doc_id, t_from, t_to, source_doc FROM patch p JOIN pdet USING (doc_id, island))),
edge_t AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, lo AS a FROM marked_t UNION SELECT doc_id, hi FROM marked_t))"""
_PAGED = rf"""
WITH RECURSIVE raw AS (SELECT doc_id AS id, string_split(regexp_replace(text, '(.{{60,80}}?) ', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
one AS (SELECT id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM raw),
page AS (
  SELECT id, i * 3 + 2 AS o, line FROM one
  UNION ALL SELECT id, i * 3, 'Report of ' || regexp_replace(substr(lines[1], 1, 30), '[.!?:;\s]+$', '') FROM one WHERE i % 20 = 0
  UNION ALL SELECT id, i * 3 + 1, CAST(i // 20 + 1 AS VARCHAR) FROM one WHERE i % 20 = 0
),
tidy AS (SELECT id, o, trim(regexp_replace(line, '[\t ]+', ' ', 'g')) AS t FROM page),
full_ AS (SELECT * FROM tidy WHERE t <> '' AND NOT regexp_matches(t, '^[0-9]{{1,4}}$')),
again AS (SELECT id, t FROM full_ WHERE length(t) <= 80 AND NOT regexp_matches(t, '[.!?]$') GROUP BY id, t HAVING count(*) >= 3),
kept AS (SELECT f.id, t, row_number() OVER (PARTITION BY f.id ORDER BY o) AS k FROM full_ f ANTI JOIN again USING (id, t)),
told AS (SELECT *, {struct._heading('x')} AS heading, {struct._contents('x')} AS entry, {struct._hit('x', '(?i)^' + struct.ln.CAPTION_WORDS + r'\s*[\-.]?\s*\d+')} AS caption FROM (SELECT *, {struct._SQUEEZED.format(x='t')} AS x FROM kept)),
flag AS (SELECT id, k, t, heading OR caption OR regexp_matches(t, '^\d+([.,]\d+)*\s*[.)]?\s') OR regexp_matches(t, '^[-–—+*•·▪●○◦>»]') OR regexp_matches(t, '(?i)^(bước|câu|ví\s*dụ|lưu\s*ý|chú\s*ý)\s*\d*\s*[:.]') AS opens, heading OR entry AS apart FROM told),
walk AS (
  SELECT id, k, 1 AS n, length(t) AS size, apart, t FROM flag WHERE k = 1
  UNION ALL
  SELECT f.id, f.k, CASE WHEN j.joins THEN w.n ELSE w.n + 1 END, CASE WHEN j.joins THEN w.size + 1 + length(f.t) ELSE length(f.t) END, CASE WHEN j.joins THEN w.apart ELSE f.apart END, f.t
  FROM walk w JOIN flag f ON f.id = w.id AND f.k = w.k + 1, LATERAL (SELECT NOT regexp_matches(w.t, '[.!?:;]\s*$') AND NOT w.apart AND NOT f.opens AND w.size >= 60 AS joins) j
),
whole AS (SELECT id, n, string_agg(t, ' ' ORDER BY k) AS line, count(*) AS own FROM walk GROUP BY id, n),
said AS (SELECT id, sum(own) AS n_kept, count(*) AS n_joined, string_agg(line, chr(10) ORDER BY n) AS text FROM whole GROUP BY id)
SELECT raw.id AS doc_id, CAST(len(lines) + 2 * ((len(lines) + 19) // 20) AS INTEGER) AS n_lines, CAST(coalesce(n_kept, 0) AS INTEGER) AS n_kept, CAST(coalesce(n_joined, 0) AS INTEGER) AS n_joined, md5(coalesce(text, '')) AS text_md5
FROM raw LEFT JOIN said USING (id)
"""
_CLEAN = r"list_filter(string_split(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_LOCATED = rf"""
WITH item AS (SELECT item_id, {_CLEAN.format(x='text')} AS sought FROM benchmark), doc AS (SELECT doc_id, {_CLEAN.format(x='text')} AS words FROM documents),
wanted AS (SELECT *, len(sought) AS n FROM item WHERE len(sought) >= 4 AND length(array_to_string(sought, ' ')) >= 10),
own AS (SELECT item_id, n, i, array_to_string(sought[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM wanted)),
there AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM doc)),
place AS (SELECT doc_id, item_id, n, there.i - own.i AS start FROM there JOIN own USING (g) WHERE there.i >= own.i GROUP BY ALL HAVING count(*) >= 0.2 * (n - 2)),
cut AS (SELECT doc_id, item_id, n, start, array_to_string(words[start + 1:start + n], ' ') AS a, array_to_string(sought, ' ') AS b FROM place JOIN doc USING (doc_id) JOIN wanted USING (item_id, n)),
near AS (SELECT *, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM cut WHERE length(a) BETWEEN 0.8 * length(b) AND 1.2 * length(b)),
pair AS (SELECT doc_id, item_id, start, g, sum(one) AS nx, sum(two) AS ny FROM (
  SELECT doc_id, item_id, start, 1 AS one, 0 AS two, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS g FROM near
  UNION ALL SELECT doc_id, item_id, start, 0, 1, unnest(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) FROM near) GROUP BY ALL),
score AS (SELECT doc_id, item_id, start, n, CASE WHEN a = b THEN 1.0 ELSE 2.0 * sum(least(nx, ny)) / (length(x) + length(y) - 2) END AS score FROM near JOIN pair USING (doc_id, item_id, start) GROUP BY doc_id, item_id, start, n, a, b, x, y)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words, round(score, 6) AS score, CAST(start // 300 + 1 AS INTEGER) AS page, CAST((start + n - 1) // 300 + 1 AS INTEGER) AS end_page
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, start) AS k FROM score WHERE score >= 0.85) WHERE k = 1
"""
_COLLATED = """
WITH titled AS (SELECT doc_id, lang, source, nullif(trim(CASE WHEN mod(doc_id, 17) > 0 THEN regexp_replace(substr(string_split(text, chr(10))[1], 1, 40), '[^\\p{L} ]', '', 'g') END), '') AS title FROM documents),
keyed AS (SELECT *, %s AS key FROM titled)
SELECT lang, source, doc_id, title, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY key COLLATE vi NULLS LAST, doc_id) AS INTEGER) AS up,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY key COLLATE vi DESC NULLS LAST, doc_id) AS INTEGER) AS down FROM keyed
"""
#: letters that Vietnamese tells apart by case, tone or foreign mark only, brought to one
_KEY = "lower(title)"
for _marked, _plain in (("áàãạảäå", "a"), ("ç", "c"), ("éèẽẹẻë", "e"), ("íìîïĩịỉ", "i"), ("ñ", "n"), ("óòõọỏö", "o"), ("úùûũụủü", "u"), ("ýÿ", "y"), ("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
    _KEY = f"regexp_replace({_KEY}, '[{_marked}]', '{_plain}', 'g')"

_BOXES = r"""
WITH printed AS (SELECT doc_id, string_split(regexp_replace(text, '(.{60,80}?) ', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
line_t AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM printed),
word_t AS (SELECT doc_id, i, string_split(line, ' ') AS words, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM line_t),
box AS (SELECT doc_id, CAST(i // 40 + 1 AS INTEGER) AS page, i * 10000 + w AS place, 5.0 * (length(array_to_string(words[1:w], ' ')) + CASE WHEN w > 0 THEN 1 ELSE 0 END) AS x, 14.0 * (i % 40) + w % 3 AS y, i, w,
  5.0 * length(word) AS width, 10.0 + w % 2 AS height FROM word_t WHERE word <> '')"""

ORACLES: dict[str, str] = {
    "points_in_tables": _BOXES + """ SELECT doc_id, page, count(*) AS n_inside, CAST(sum(place) AS BIGINT) AS places FROM (SELECT *, 14.0 * ((doc_id + page) % 30) AS top FROM box)
WHERE x BETWEEN 18 AND 232 AND y BETWEEN top - 2 AND top + 72 GROUP BY doc_id, page""",
    # lines are 14 apart and boxes within 3, so the boxes of a printed line are those of a line of boxes; lines that do come near are tested on made rows
    "box_lines": _BOXES + """ SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INTEGER) AS line, y, x_from, x_to, height, n FROM
(SELECT doc_id, page, i, arg_min(y, place) AS y, min(x) AS x_from, max(x + width) AS x_to, max(height) AS height, count(*) AS n FROM box WHERE y + height / 2 BETWEEN 28 AND 532 GROUP BY doc_id, page, i)""",
    "segmented_tokens": _SEGMENTED,
    "content_tokens_stopped": _STOPPED,
    "elementary_spans": overlap._with(overlap._INDEX + overlap._PATCH + _PIECES, "SELECT e.doc_id, a AS p_from, CAST(b - 1 AS INTEGER) AS p_to, source_doc FROM edge_t e JOIN marked_t m ON m.doc_id = e.doc_id AND m.lo <= a AND b <= m.hi"),
    "running_header_removal": _PAGED,
    "located_sentences": _LOCATED,
    "collated_titles": _COLLATED % _KEY,
}
