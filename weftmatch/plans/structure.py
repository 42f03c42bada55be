"""Queries over the lines of ``documents`` and ``pages``: what a line is, which lines are compared, which belong together.

The SQL beside them is written from the rules, for an engine without lookahead: only the word lists are shared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.text import let
from ..operators import regions as rg
from ..sources.lines import report_lines, text_lines

#: lines as long as those of a printed page
WIDTH = r"(.{60,80}?) "


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark, sf_dir).select("kind", "id", F.posexplode("lines").alias("pos", "line"))
    t = ln.normal(ln.without_bullets(ln.without_labels(F.col("line"))))
    told = let(t, lambda t: let(ln.line_class(ln.label_of(F.col("line")), t), lambda c: F.struct(c.alias("class"), ln.kept_text(c, t).alias("kept"), t.alias("t"))))
    return rows.select("kind", "id", (F.col("pos") + 1).alias("line_no"), told.alias("told")).select("kind", "id", "line_no", "told.*")


def line_kinds(spark, d):
    return _classed(spark, d).select("kind", "id", "line_no", "class", F.md5("kept").alias("kept_md5"))


def line_class(spark, d):
    return _classed(spark, d).groupBy("kind", "class").agg(F.count("*").alias("n_lines"), F.sum(F.length("kept")).cast("long").alias("n_kept"))


def heading_keys(spark, d):
    return _classed(spark, d).where("class IN ('heading', 'contents', 'sub_heading')").select("kind", "id", "line_no", ln.heading_key(F.col("t")).alias("key"))


def region_lines(spark, d):
    found = rg.with_regions(_reports(spark, d))
    rows = found.select("kind", "id", "compared", F.posexplode("regions").alias("pos", "region"))
    return rows.select("kind", "id", (F.col("pos") + 1).alias("line_no"), "region", F.array_contains("compared", F.col("pos") + 1).alias("is_compared"))


def prepared_content(spark, d):
    found = rg.prepared(_reports(spark, d))
    return found.select("kind", "id", F.size("content").alias("n_lines"), F.md5(F.array_join("content", "\n")).alias("content_md5"))


def joined_lines(spark, d):
    """Texts broken into lines as on a printed page are put together again."""
    broken = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text_lines(F.regexp_replace("text", WIDTH, "$1\n")).alias("lines"))
    joined = rg.join_sentences(broken, "lines", "joined").select("doc_id", F.size("lines").alias("n_broken"), F.posexplode("joined").alias("pos", "line"))
    return joined.select("doc_id", "n_broken", (F.col("pos") + 1).alias("line_no"), F.md5("line").alias("line_md5"), F.length("line").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (line_kinds, line_class, heading_keys, region_lines, prepared_content, joined_lines)}


def _hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


_END = r"([^\p{L}\p{N}]|$)"
_names = lambda names, before="", end=_END: rf"(?i)^{before}({'|'.join(names)}){end}"
_CH = rf"^(?i:{'|'.join(ln.CHAPTER_WORDS)})"
_CHAPTER = _CH + r"\s*[:\-]?\s*(\d+|[IVXLCDM]+)([^\p{L}\p{N}#+]|$)"
_BARE = r"trim(regexp_replace({x}, '[\s\p{{Z}}\x{{85}}\x{{200B}}\x{{FEFF}}]+', ' ', 'g'))"
_SQUEEZED = "trim(regexp_replace(regexp_replace(" + _BARE + r", '^[_*~=]+\s*', ''), '\s*[_*~=]+$', ''))"
_UNLABELLED = r"regexp_replace({x}, '\x01[A-Z]{{2,3}}\x02', '', 'g')"


def _n(x: str, kind: str) -> str:
    return f"length({_cut(x, '[^' + kind + ']')})"


def _heading(t: str) -> str:
    letters, small = _n(t, r"\p{L}"), _n(t, r"\p{Ll}")
    form = rf"length({t}) BETWEEN 4 AND 80 AND NOT {_hit(t, '[.!?,;:]$')} AND {letters} >= 4 AND contains({t}, ' ') AND 10 * ({letters} - {small}) >= 7 * {letters}"
    return f"({t} <> '' AND ({_hit(t, _names(ln.FIXED_HEADINGS))} OR {_hit(t, _CHAPTER)} OR ({form})))"


def _contents(t: str) -> str:
    bare = rf"regexp_replace({t}, '\s+\d{{1,3}}\s*$', '')"
    dots = _hit(t, r"[.·…]{3,}\s*\d{1,4}\s*$|[.·…]{5,}\s*\d{0,4}\s*$|^[.·…]{3,}\s*\d*\s*$")
    numbered = f"({_hit(bare, _CHAPTER)} OR {_hit(bare, r'^\d+([.,]\d+)*\s+\S')} OR {_hit(bare, r'(?i)^[IVXLCDM]+\.\s+\S')} OR {_hit(bare, _names(ln.FIXED_HEADINGS))})"
    sentence = _hit(t, rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(ln.NUMBER_WORDS)})\s+\d{{1,3}}$")
    plain = rf"length({bare}) <= 70 AND {_hit(bare, r'^\p{Lu}')} AND NOT {_hit(bare, '[.!?,;:]$')} AND contains({bare}, ' ') AND NOT {sentence}"
    # without lookahead the character after the number comes off with it; it is no letter, so the count of letters stays
    name = rf"regexp_replace(regexp_replace(regexp_replace({bare}, '{_CHAPTER}', ' '), '^\s*\d+([.,]\d+)*\s*[.):]?', ''), '(?i)^\s*[IVXLCDM]+\s*[.):]', '')"
    return f"({t} <> '' AND ({dots} OR ({bare} <> {t} AND length({t}) < 120 AND CASE WHEN {numbered} THEN {_n(name, chr(92) + 'p{L}')} >= 3 ELSE {plain} END)))"


def _profile(t: str) -> str:
    school = _hit(t, "(?i)" + ln.SCHOOL + "([^A-Za-z0-9_]|$)")
    return f"({_hit(t, '(?i)' + ln.PROFILE_LABEL)} OR (length({t}) <= 160 AND NOT (length({t}) > 80 AND {school} AND {_hit(t, '(?i)' + ln.SCHOOL_SENTENCE)}) AND ({school} OR {_hit(t, '(?i)' + ln.PROFILE_OTHER)})))"


def _signature(t: str) -> str:
    before = rf"CASE WHEN {_hit(t, r'(?i)ngày\s+\d')} THEN regexp_extract({t}, '(?i)^(.*?)ngày\s+\d', 1) ELSE {t} END"
    told = f"(length({before}) > 25 AND NOT contains({before}, ',')) OR {_hit(t, '(?i)' + ln.DATE_SENTENCE)} OR (length({t}) > 60 AND NOT {_hit(t, '(?i)' + ln.DATE_FIRST)})"
    return f"({t} <> '' AND NOT ({told}) AND ({_hit(t, '(?i)' + ln.SIGNATURE)} OR ({_hit(t, '(?i)' + ln.PLACE_YEAR[0])} AND {_hit(t, '(?i)' + ln.PLACE_YEAR[1])})))"


def _numbered(t: str) -> str:
    """The text after a heading's mark, null without a mark."""
    figures, roman, letter = r"^\d+([.,]\d+)*[.):]?", r"(?i)^[IVXLCDM]+[.):]", r"^[A-Za-zÀ-Ỹà-ỹ][.):]"
    return (
        rf"CASE WHEN {_hit(t, figures + '([ ]|$)')} OR {_hit(t, r'^\d+([.,]\d+)*[.):]')} THEN trim(regexp_replace({t}, '{figures}', ''))"
        rf" WHEN {_hit(t, roman)} THEN trim(regexp_replace({t}, '{roman}', '')) WHEN {_hit(t, letter)} THEN trim(regexp_replace({t}, '{letter}', ''))"
        rf" WHEN {_hit(t, r'^\d+([.,]\d+)+[A-ZÀ-Ỹ]')} THEN trim(regexp_replace({t}, '^\d+([.,]\d+)+', '')) END"
    )


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_HTML = "html"
for _names_of in ("script", "style"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_names_of}\b.*?</{_names_of}\s*>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g'), '\s+', ' ', 'g')"
for _tags, _label in (("title|h[1-6]", "TD"), ("li", "ML"), ("td|th", "BG"), ("figcaption|caption", "CT"), ("div|footer|aside|header", "HVB")):
    _HTML = rf"regexp_replace({_HTML}, '(?i)<({_tags})(\s[^>]*)?>', chr(10) || chr(1) || '{_label}' || chr(2), 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?i)<(p|br|tr|ul|ol|table|article|section|main|nav|body)(\s[^>]*)?/?>|</(title|h[1-6]|li|td|th|div|footer|aside|header|p|tr|article|section|nav)\s*>', chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '<[^>]*>', '', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_char}')"

_LINES = rf"""
WITH RECURSIVE arrays AS (
  SELECT 'document' AS kind, doc_id AS id, string_split_regex(text, '\r?\n') AS lines FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'page', page_id, list_filter(string_split({_HTML}, chr(10)), lambda x: trim({_UNLABELLED.format(x='x')}) <> '') FROM pages WHERE html IS NOT NULL
)"""
_BULLETS = r"^(\s*([-–—+*•·▪●○◦>»‣⁃➢➣➤❖✓✔]+|o\p{Lu}))+\s*"
#: a round bullet ends before the capital that shows it, so the capital is put back
_ITEM = rf"CASE WHEN regexp_matches(u, '{_BULLETS}') THEN trim(regexp_extract(u, '{_BULLETS}', 2).regexp_extract('\p{{Lu}}$') || regexp_replace(u, '{_BULLETS}', '')) ELSE trim(u) END"
_CLASS = rf"""
SELECT *, CASE label WHEN 'TD' THEN 'heading' WHEN 'ML' THEN 'contents' WHEN 'CT' THEN 'caption' WHEN 'BG' THEN 'table' WHEN 'HVB' THEN 'text_box' ELSE CASE
  WHEN t = '' THEN 'empty' WHEN {_hit('t', '^[0-9]{1,4}$')} THEN 'page_number' WHEN {_heading('t')} THEN 'heading' WHEN {_contents('t')} THEN 'contents'
  WHEN {_hit('t', '(?i)^' + ln.CAPTION_WORDS + r'\s*[\-.]?\s*\d+')} THEN 'caption'
  WHEN length(t) >= 12 AND len(regexp_extract_all(t, '\p{{Ll}}\p{{Lu}}')) >= 2 THEN 'glued_row' WHEN {_profile('t')} THEN 'profile' WHEN {_signature('t')} THEN 'signature'
  WHEN length(t) <= 40 AND NOT regexp_matches(t, '[\d.,;:!?()\-–—/]') AND len(string_split(t, ' ')) <= 5
    AND list_bool_and(list_transform(string_split(t, ' '), lambda w: regexp_matches(w, '^\p{{Lu}}'))) THEN 'name'
  WHEN {_hit("regexp_replace(t, '(?i)^(" + chr(92) + "d+([.,]" + chr(92) + "d+)*|[IVXLCDM]+|[A-Za-z])[.):]" + chr(92) + "s*', '')", '(?i)' + ln.OUTLINE)} THEN 'outline'
  WHEN lower(t) IN ({_listed(ln.TABLE_LABELS)}) THEN 'table_label' WHEN upper(t) IN ({_listed(ln.KEY_WORDS)}) THEN 'key_word'
  WHEN rest IS NOT NULL AND length(rest) < 80 AND NOT (regexp_matches(rest, '[.!?]$') AND len(string_split(rest, ' ')) > 8) THEN 'sub_heading' ELSE 'text' END END AS class
FROM (SELECT *, {_numbered('t')} AS rest FROM (
  SELECT kind, id, line_no, label, {_SQUEEZED.format(x=_ITEM)} AS t FROM (
    SELECT kind, id, line_no, nullif(regexp_extract(line, '^\x01([^\x02]*)\x02', 1), '') AS label, {_UNLABELLED.format(x='line')} AS u
    FROM (SELECT kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM arrays))))"""
_KINDS = _LINES + f", classed AS ({_CLASS}), kept AS (SELECT *, CASE WHEN class = 'text' THEN coalesce(nullif(rest, ''), t) ELSE '' END AS kept FROM classed)"


def _regions(arrays: str) -> str:
    """Flags, then one step a line: the state after each line follows from the state before it."""
    opening = _names(ln.OPENINGS, rf"(([A-Z]|[IVXLCDM]+|\d+)\s*[.:)\-]\s*)?")
    block = _names(ln.BLOCK_HEADINGS, rf"({'|'.join(ln.BLOCK_PREFIXES)})?\s*")
    return rf""",
lined AS (SELECT kind, id, line_no, coalesce(nullif(regexp_extract(line, '^\x01([^\x02]*)\x02', 1), ''), '-') AS label, {_SQUEEZED.format(x=_UNLABELLED.format(x='line'))} AS t
  FROM (SELECT kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM {arrays})),
told AS (SELECT *, {_contents('t')} AS toc, {_profile('t')} AS profile, {_heading('t')} AS form FROM lined),
flags AS (
  SELECT kind, id, line_no, t = '' OR regexp_matches(t, '^[0-9]{{1,4}}$') AS blank, label = 'ML' AS listed, toc, length(t) >= 150 AND regexp_matches(t, '[.!?]["''”’)\]]?$') AS prose,
    CASE WHEN toc OR profile OR NOT (label = 'TD' OR form) THEN NULL WHEN {_hit('t', block)} THEN 'skipped' ELSE 'body' END AS opens,
    {_hit('t', _CHAPTER)} OR {_hit('t', _names(ln.BODY_HEADINGS))} AS named, {_hit('t', _names(ln.TO_THE_END, end=''))} AS last, {_hit('t', _names(ln.NAMES_ONLY, end=''))} AS list,
    NOT toc AND {_hit('t', opening)} AS opening, NOT toc AND {_hit('t', _CH + r'\s*[:\-–]?\s*(1|I)([^\p{L}\p{N}]|$)')} AS chapter
  FROM told
),
walk AS (
  SELECT kind, id, 0::BIGINT AS line_no, 'cover' AS state, false AS to_end, false AS in_list, 0 AS gone, false AS entries, '' AS region FROM {arrays}
  UNION ALL
  SELECT s.kind, s.id, f.line_no, n.state,
    CASE WHEN w.what = 'turn' THEN f.opens = 'skipped' AND f.last ELSE s.to_end END,
    CASE w.what WHEN 'turn' THEN f.opens = 'skipped' AND f.list WHEN 'listed' THEN true WHEN 'prose' THEN false ELSE s.in_list END,
    CASE WHEN w.what = 'turn' THEN 0 WHEN w.what IN ('listed', 'entry') OR (w.what = 'line' AND n.state <> 'body') THEN s.gone + 1 ELSE s.gone END,
    s.entries OR w.what IN ('listed', 'entry') OR (w.what = 'line' AND n.state <> 'body' AND s.in_list),
    CASE WHEN w.what IN ('turn', 'prose', 'line') AND NOT (n.state = 'body' AND f.toc AND w.what <> 'turn') THEN n.state WHEN s.state = 'body' OR n.state = 'body' THEN 'skipped' ELSE s.state END
  FROM walk s JOIN flags f ON f.kind = s.kind AND f.id = s.id AND f.line_no = s.line_no + 1,
  LATERAL (SELECT CASE WHEN f.blank THEN 'blank' WHEN f.listed THEN 'listed' WHEN f.opens = 'body' AND s.state = 'cover' AND NOT f.named THEN 'cover'
      WHEN f.opens = 'body' AND s.in_list AND NOT s.entries THEN 'entry' WHEN f.opens IS NOT NULL THEN 'turn'
      WHEN f.prose AND (s.state = 'cover' OR s.in_list OR (s.state = 'skipped' AND NOT s.to_end AND s.gone >= 40)) THEN 'prose' ELSE 'line' END AS what) w,
  LATERAL (SELECT CASE w.what WHEN 'turn' THEN f.opens WHEN 'prose' THEN 'body' ELSE s.state END AS state) n
),
placed AS (SELECT w.*, f.opening, f.chapter FROM walk w JOIN flags f USING (kind, id, line_no)),
marks AS (
  SELECT kind, id, count_if(region = 'body') AS n, max(line_no) FILTER (region = 'body') AS final,
    coalesce(min(line_no) FILTER (region = 'body' AND opening), min(line_no) FILTER (region = 'body' AND chapter), 0) AS mark
  FROM placed GROUP BY kind, id
)"""


_COMPARED = "(n = 0 OR (region = 'body' AND (line_no > mark OR final = mark)))"
_WRAPPED = r"""
WITH RECURSIVE broken AS (SELECT doc_id AS id, 'w' AS kind, string_split(regexp_replace(text, '(.{60,80}?) ', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL)"""


def _opens_apart(t: str, x: str) -> str:
    caption = _hit(t, r"(?i)^(hình(\s*ảnh)?|bảng|biểu\s*đồ|sơ\s*đồ|đồ\s*thị|figure|fig|table)\s*\d+(\s*[.,]\s*\d+)*\s*[.:–—-]\s")
    numbered = f"({_hit(t, r'^\d+(\.\d+)+\.?\s+\p{Lu}\p{Ll}')} AND length({t}) <= 80 AND NOT {_hit(t, '[.!?;]$')})"
    return f"({_heading(x)} OR {_contents(x)} OR {caption} OR {numbered} OR {_hit(t, r'^\s*([-–—+*•·▪●○◦>»‣⁃➢➣➤❖✓✔]+|o\p{Lu})')})"


_JOIN = rf""",
flat AS (SELECT id, line_no, trim(line) AS t, {_SQUEEZED.format(x='line')} AS x FROM (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM broken)),
full_ AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY line_no) AS k, {_opens_apart('t', 'x')} AS apart FROM flat WHERE t <> ''),
fold AS (
  SELECT id, k, 1 AS line_no, length(t) AS size, t FROM full_ WHERE k = 1
  UNION ALL
  SELECT f.id, f.k, CASE WHEN j.joins THEN s.line_no ELSE s.line_no + 1 END, CASE WHEN j.joins THEN s.size + 1 + length(f.t) ELSE length(f.t) END, f.t
  FROM fold s JOIN full_ f ON f.id = s.id AND f.k = s.k + 1,
  LATERAL (SELECT NOT regexp_matches(s.t, '[.!?:;]$') AND NOT f.apart AND (regexp_matches(f.t, '^\p{{Ll}}') OR s.size >= 60) AS joins) j
),
whole AS (SELECT id, line_no, string_agg(t, ' ' ORDER BY k) AS line FROM fold GROUP BY id, line_no)
SELECT id AS doc_id, CAST(len(lines) AS INTEGER) AS n_broken, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line_md5, CAST(length(line) AS INTEGER) AS n_chars
FROM whole JOIN broken USING (id)
"""
#: tidy lines without side parts, then headings joined: the state is how many lines the open heading has taken
_PREPARED = rf""",
tidy AS (SELECT kind, id, list_filter(list_transform(lines, lambda x: trim(regexp_replace(replace(x, chr(9), ' '), ' {{2,}}', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^\x01(CT|BG|HVB)\x02')) AS lines FROM arrays),
part AS (SELECT kind, id, n, t, x, t = '' AS empty, regexp_matches(t, '^[0-9]{{1,4}}$') AS page, {_contents('x')} AS toc, regexp_replace(x, '[^\p{{L}}]', '', 'g') AS letters,
    {_heading('x')} OR starts_with(t, chr(1) || 'TD' || chr(2)) AS heading, {_hit('x', r'(?i)^(CHƯƠNG|CHUONG|PHẦN|PHAN|CHAPTER|PART)\s*[:\-–]?\s*(\d+|[IVXLCDM]+)\s*[:.\-–]?$')} AS unnamed
  FROM (SELECT kind, id, n, trim(line) AS t, {_SQUEEZED.format(x=_UNLABELLED.format(x='line'))} AS x FROM (SELECT kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM tidy))),
piece AS (SELECT *, NOT toc AND x <> '' AND length(x) <= 100 AND NOT regexp_matches(x, '[.!?;,]$') AND letters <> '' AND (letters = upper(letters) OR regexp_matches(x, '^\p{{Lu}}')) AS fits,
    length(letters) >= 3 AND 10 * length(regexp_replace(letters, '\p{{Ll}}', '', 'g')) >= 9 * length(letters) AS capitals FROM part),
head AS (
  SELECT kind, id, 0::BIGINT AS n, CAST(NULL AS INTEGER) AS taken, 'gone' AS what FROM tidy
  UNION ALL
  SELECT h.kind, h.id, p.n, CASE w.what WHEN 'gone' THEN CASE WHEN h.taken < 3 AND p.page THEN h.taken END WHEN 'more' THEN h.taken + 1 ELSE CASE WHEN p.heading AND NOT p.toc AND p.unnamed THEN 0 END END, w.what
  FROM head h JOIN piece p ON p.kind = h.kind AND p.id = h.id AND p.n = h.n + 1,
  LATERAL (SELECT CASE WHEN h.taken < 3 AND p.page THEN 'gone' WHEN h.taken < 3 AND p.fits AND (h.taken = 0 OR p.capitals) THEN 'more' WHEN p.empty THEN 'gone' ELSE 'new' END AS what) w
),
numbered AS (SELECT h.kind, h.id, p.n, p.t, count_if(h.what = 'new') OVER (PARTITION BY h.kind, h.id ORDER BY p.n) AS k FROM head h JOIN piece p USING (kind, id, n) WHERE h.what <> 'gone'),
whole AS (SELECT kind, id, k, string_agg(t, ' ' ORDER BY n) AS line FROM numbered GROUP BY kind, id, k),
joined_a AS (SELECT kind, id, coalesce((SELECT list(line ORDER BY k) FROM whole w WHERE w.kind = tidy.kind AND w.id = tidy.id), []) AS lines FROM tidy)"""
_KEY = r"regexp_replace(regexp_replace(regexp_replace(t, '[.·…]{2,}\s*\d*\s*$', ''), '\s+\d{1,3}\s*$', ''), '[\s:.\-–)]+$', '')"

ORACLES: dict[str, str] = {
    "line_kinds": _KINDS + " SELECT kind, id, CAST(line_no AS INTEGER) AS line_no, class, md5(kept) AS kept_md5 FROM kept",
    "line_class": _KINDS + " SELECT kind, class, count(*) AS n_lines, CAST(sum(length(kept)) AS BIGINT) AS n_kept FROM kept GROUP BY kind, class",
    "heading_keys": _KINDS + rf"""
SELECT kind, id, CAST(line_no AS INTEGER) AS line_no, coalesce(nullif(regexp_replace(lower({_KEY}), '[^\p{{L}}\p{{N}}]', '', 'g'), ''), lower(t)) AS key
FROM kept WHERE class IN ('heading', 'contents', 'sub_heading')""",
    "region_lines": _LINES + _regions("arrays") + f" SELECT kind, id, CAST(line_no AS INTEGER) AS line_no, region, {_COMPARED} AS is_compared FROM placed JOIN marks USING (kind, id)",
    "joined_lines": _WRAPPED + _JOIN,
    "prepared_content": _LINES + _PREPARED + _regions("joined_a") + f""",
kept_l AS (SELECT kind, id, line_no AS spot FROM placed JOIN marks USING (kind, id) WHERE {_COMPARED}),
said AS (SELECT kind, id, count(*) AS n, string_agg(line, chr(10) ORDER BY spot) AS text FROM kept_l JOIN (SELECT kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS spot FROM joined_a) l USING (kind, id, spot) GROUP BY kind, id)
SELECT tidy.kind, tidy.id, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, md5(coalesce(text, '')) AS content_md5 FROM tidy LEFT JOIN said ON said.kind = tidy.kind AND said.id = tidy.id""",
}
