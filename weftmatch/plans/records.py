"""Reports, classes, formats and upkeep in DataFrames, each with DuckDB SQL written from its rule.

The tables stand for the application's as in ``reports``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import text as tx
from ..functions.text import let
from ..operators import records as rc
from . import layout, overlap
from . import structure as struct

#: reports whose last check run is at least this old have expired
EXPIRED = "2024-01-30 06:00:00"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _runs(spark, d):
    """The latest check run of each report."""
    return rc.latest(_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type", "value"])


def _state(spark, d):
    report = _table(spark, d, "customer").select(F.col("c_custkey").alias("report"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("class_id"))
    ratio = F.when(F.col("event_type") == "error", 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value"))))
    return report.join(_runs(spark, d), F.col("report") == F.col("user_id"), "left").select("report", "title", "class_id", "ts", F.when(F.col("user_id").isNotNull(), ratio).alias("ratio"))


def mean_ignoring_null(spark, d):
    """Mean overlap of each class times 100; ratios are summed as whole ten-thousandths, so the order of rows plays no part."""
    whole = F.floor(F.col("ratio") * 10000 + 0.5)
    sums = _state(spark, d).groupBy("class_id").agg(F.sum(whole).alias("s"), F.count("ratio").alias("n"))
    return sums.select("class_id", F.expr("CASE WHEN n > 0 THEN (s + 50 * n) div (100 * n) END").alias("mean_x100"), "n")


def percent_text(x: Column) -> Column:
    """Percent with one decimal, none where it is nought; null is 0%."""
    tenths = F.floor(x * 10 + 0.5)
    return F.when(x.isNull(), "0%").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit("%")))


def percent_formats(spark, d):
    return _state(spark, d).select("report", percent_text(F.col("ratio")).alias("shown"), F.format_string("%.2f", F.floor(F.coalesce("ratio", F.lit(0.0)) + 0.5) / 100).alias("fraction"))


def date_formats(spark, d):
    """When a report was last checked, day first, with hours and minutes; two dashes where it never was."""
    return _state(spark, d).select("report", F.coalesce(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit("--")).alias("shown"))


def file_names(spark, d):
    """Names of files at the end of page addresses, fit for a file system, in stem and extension."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[^:]*://[^/]*", "")
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1), r"[^\p{L}\p{N}._-]+", "_")
    named = _table(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.when(name == "", "index").otherwise(name).alias("name"))
    return named.select("page_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("ext"))


def page_number_lines(spark, d):
    """Printed pages of each document: lines of a page number."""
    lines = layout._pages(spark, d).select("doc_id", F.explode("lines").alias("line"))
    return lines.where(ln.is_page_number(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max(F.col("line").cast("int")).alias("last_page"))


def repeated_lines(spark, d):
    """Running headers: lines of one text that come three times or more, within 80 characters, without a closing mark."""
    lines = layout._pages(spark, d).select("doc_id", F.explode("lines").alias("line")).select("doc_id", F.trim("line").alias("line"))
    kept = lines.where((F.col("line") != "") & (F.length("line") <= 80) & ~F.col("line").rlike("[.!?]$"))
    return kept.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


def _outlined(spark, d):
    """Lines in the forms of headings and tables, made of the lines of ``documents`` by their place; ß has the capital ẞ."""
    rows = _table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    s = F.regexp_replace(F.substring("line", 1, 50), r"[.!?,;:\s]+$", "")
    forms = [F.concat(F.lit("1."), (F.col("pos") + 1).cast("string"), F.lit(" "), s), F.concat(F.lit("IV. "), s), F.concat(F.lit("b) "), s), F.upper(F.replace(s, F.lit("ß"), F.lit("ẞ"))), F.replace(s, F.lit(" "), F.lit("Ô")), F.concat(F.lit("2.3Đ"), s)]
    form = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        form = F.when(F.col("pos") % len(forms) == k, f).otherwise(form)
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), ln.squeeze(form).alias("t"))


def heading_form(spark, d):
    return _outlined(spark, d).where(let(F.col("t"), ln.is_heading_by_form)).select("doc_id", "line_no")


def glued_row(spark, d):
    return _outlined(spark, d).where(let(F.col("t"), ln.is_glued_row)).select("doc_id", "line_no", F.md5("t").alias("line_md5"))


def numbering_split(spark, d):
    found = _outlined(spark, d).select("doc_id", "line_no", let(F.col("t"), ln.numbering).alias("x")).where("x IS NOT NULL")
    return found.select("doc_id", "line_no", "x.mark", F.md5("x.rest").alias("rest_md5"))


def _expired(spark, d):
    return _state(spark, d).where(f"ts < TIMESTAMP '{EXPIRED}'").select("report")


def retention_cascade(spark, d):
    """Rows that go and stay, table by table, when expired reports are deleted with all that hangs on them."""
    tables = {"events": (_table(spark, d, "events"), "user_id"), "orders": (_table(spark, d, "orders"), "o_custkey"), "customer": (_table(spark, d, "customer"), "c_custkey")}
    left = rc.without_keys(tables, _expired(spark, d), "report")
    parts = [left[n].agg(F.count("*").alias("n_kept")).join(tables[n][0].agg(F.count("*").alias("n"))).select(F.lit(n).alias("table_name"), "n_kept", (F.col("n") - F.col("n_kept")).alias("n_removed")) for n in tables]
    return parts[0].union(parts[1]).union(parts[2])


def _sources(spark, d):
    """Submissions, each with an array of its sources (the suppliers of its lines, a few each)."""
    items = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    return items.select(F.col("l_orderkey").alias("submission"), F.transform("x", lambda s: s["l_suppkey"]).alias("sources"))


def _shown(rows):
    return rows.select("submission", F.size("sources").alias("n"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


def rename_nested(spark, d):
    names = _table(spark, d, "supplier").where("s_suppkey % 10 = 3").select("s_suppkey", (F.col("s_suppkey") + 900000).alias("new_key"))
    return _shown(rc.rename_nested(_sources(spark, d), "submission", "sources", names, "s_suppkey", "new_key"))


def cascade_delete(spark, d):
    """Sources in arrays of submissions go with the sources that are deleted (those with a debt)."""
    return _shown(rc.without_nested(_sources(spark, d), "submission", "sources", _table(spark, d, "supplier").where("s_acctbal < 0"), "s_suppkey"))


def rename_and_clamp(spark, d):
    """Check runs with the field ``value`` renamed and held to 0 to 100 inside a structure; ``repaired`` where that changed it."""
    runs = _table(spark, d, "events").select("event_id", F.struct(F.col("value").alias("percent"), "event_type").alias("result"))
    fixed = runs.withColumn("fixed", F.struct(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("result.percent"))).alias("ratio"), F.col("result.event_type").alias("kind")))
    return fixed.select("event_id", "fixed.ratio", "fixed.kind", (F.col("fixed.ratio") != F.col("result.percent")).alias("repaired"))


def status_repair(spark, d):
    """Submitted reports that claim to be finished and have no result in the last day are set back."""
    recent = _table(spark, d, "events").where(f"ts >= TIMESTAMP '{EXPIRED}'").select("user_id").distinct()
    claimed = _table(spark, d, "orders").where("o_orderstatus = 'F'")
    back = claimed.join(recent, claimed.o_custkey == recent.user_id, "left")
    return back.select("o_orderkey", F.when(F.col("user_id").isNull(), "waiting").otherwise("done").alias("status"))


def teacher_scope(spark, d):
    """Classes, members and pending reports in the scope of each teacher; counted by class before the join."""
    waiting = _table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    members = _table(spark, d, "customer").join(waiting, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("reports"))
    classes = _table(spark, d, "nation").join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    scoped = _table(spark, d, "supplier").join(classes, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return scoped.select(F.col("s_suppkey").alias("teacher"), F.col("n_nationkey").isNotNull().cast("long").alias("classes"), zero("members"), zero("reports"))


def member_accounts(spark, d):
    """Members of each class with their account, if there is one; memberships are rows."""
    customer = _table(spark, d, "customer")
    moved = F.col("c_custkey") + F.when(F.col("c_custkey") % 9 == 0, 1000000).otherwise(0)
    members = customer.select(F.col("c_nationkey").alias("class_id"), moved.alias("member"))
    return members.join(customer.select(F.col("c_custkey").alias("member"), F.col("c_name").alias("account")), "member", "left").select("class_id", "member", "account")


def member_submissions(spark, d):
    """Members of each class with their latest submission and its overlap; one without a submission under the own key is looked for by name."""
    customer, orders = _table(spark, d, "customer"), _table(spark, d, "orders")
    last = rc.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    # one submission in four was handed in under the name alone
    by_key = last.where("o_custkey % 4 > 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("by_key"))
    named = last.where("o_custkey % 4 = 0").select(F.concat(F.lit(" customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"), F.col("o_orderkey").alias("by_name"))
    key = F.lower(F.trim(F.regexp_replace("c_name", r"\s+", " ")))
    members = customer.withColumn("key", key).join(by_key, "c_custkey", "left").join(named.select(F.lower(F.trim("name")).alias("key"), "by_name"), "key", "left")
    found = members.select(F.col("c_nationkey").alias("class_id"), F.col("c_custkey").alias("member"), F.coalesce("by_key", "by_name").alias("submission"), F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_name").isNotNull(), "name").alias("found_by"))
    return found.join(_state(spark, d).select(F.col("report").alias("member"), F.round("ratio", 6).alias("ratio")), "member", "left").select("class_id", "member", "submission", "found_by", "ratio")


def null_last_sort(spark, d):
    """Places of reports within their class by overlap, either way; those without one come last both times."""
    place = lambda *order: F.row_number().over(Window.partitionBy("class_id").orderBy(*order))
    return _state(spark, d).select("class_id", "report", F.round("ratio", 6).alias("ratio"), place(F.desc_nulls_last("ratio"), "report").alias("down"), place(F.asc_nulls_last("ratio"), "report").alias("up"))


def identity_resolution(spark, d):
    """Who a code belongs to: a student's name, else a teacher's; codes of all submissions, some unknown."""
    customer, supplier = _table(spark, d, "customer"), _table(spark, d, "supplier")
    codes = customer.select(F.col("c_name").alias("code")).union(supplier.select("s_name")).union(customer.where("c_custkey % 10 = 0").select(F.concat(F.lit("old "), F.col("c_name")))).distinct()
    own = codes.join(customer.select(F.col("c_name").alias("code"), "c_custkey"), "code", "left").join(supplier.select(F.col("s_name").alias("code"), "s_suppkey"), "code", "left")
    return own.select("code", F.coalesce("c_custkey", "s_suppkey").alias("user_id"), F.when(F.col("c_custkey").isNotNull(), "student").when(F.col("s_suppkey").isNotNull(), "teacher").alias("role"))


def insert_defaults(spark, d):
    """Profiles of all who submitted or ran a check: known ones as they are, new ones with defaults."""
    ids = _table(spark, d, "orders").select(F.col("o_custkey").alias("id")).union(_table(spark, d, "events").select(F.col("user_id") * 2)).distinct()
    known = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return ids.join(known, "id", "left").select("id", F.coalesce("c_mktsegment", F.lit("NEW")).alias("segment"), F.col("c_mktsegment").isNull().alias("inserted"))


def roster_emails(spark, d):
    """Accounts of all addresses on the roster, whatever their case."""
    roster = _table(spark, d, "customer").select(F.concat(F.upper("c_name"), F.lit("@SCHOOL")).alias("address"))
    accounts = _table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lower("c_name"), F.lit("@school")).alias("email"), F.col("c_custkey").alias("account"))
    return roster.select(F.lower("address").alias("email")).join(accounts, "email", "left")


def _texts(rows: DataFrame, index: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """The sentences from ``t_from`` to ``t_to`` of a document, joined in order; looked up by equality."""
    own = index.select(F.col("doc_id").alias(side), F.col("idx").alias("at"), "content")
    each = rows.withColumn("at", F.explode(F.sequence("lo", "hi"))).join(own, [side, "at"])
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), " ").alias("text"))


def passage_texts(spark, d):
    """Texts of every passage on both sides, with the words of the submission's; a text is as long as its passage."""
    index = overlap._index(spark, d)
    found = overlap._spans(spark, d)[1].select("doc_id", "source_doc", "t_from", "t_to", "s_from", "s_to", "n")
    keys = ["doc_id", "source_doc", "t_from", "s_from"]
    target = _texts(found.select(*keys, F.col("t_from").alias("lo"), F.col("t_to").alias("hi")), index.where("NOT is_sample"), "doc_id", keys)
    source = _texts(found.select(*keys, F.col("s_from").alias("lo"), F.col("s_to").alias("hi")), index.where("is_sample"), "source_doc", keys)
    both = found.join(target, keys).join(source.withColumnRenamed("text", "source_text"), keys)
    return both.select(*keys, F.md5("text").alias("text_md5"), F.md5("source_text").alias("source_md5"), F.length("text").alias("n_chars"))


def patchwork_texts(spark, d):
    index = overlap._index(spark, d)
    found = overlap._spans(spark, d)[2].select("doc_id", "t_from", F.col("t_from").alias("lo"), F.col("t_to").alias("hi"))
    texts = _texts(found, index.where("NOT is_sample"), "doc_id", ["doc_id", "t_from"])
    return texts.select("doc_id", "t_from", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def source_drilldown(spark, d):
    """For each submission and source: its matched sentences with their kind, and passages and patchworks of that source around them."""
    (_, passages, patchworks), flags = overlap._spans(spark, d), ("in_passage", "in_patchwork")
    marked = lambda rows, *told: rows.select("doc_id", "source_doc", F.explode(F.sequence("t_from", "t_to")).alias("idx"), *[F.lit(t).alias(f) for f, t in zip(flags, told, strict=True)])
    parts = patchworks.select("doc_id", "t_from", "t_to", F.explode("detail.source_doc").alias("source_doc"))
    inside = marked(passages, True, False).union(marked(parts, False, True)).groupBy("doc_id", "source_doc", "idx").agg(*[F.max(f).alias(f) for f in flags])
    # spans unfold to far more rows than their stored size tells, so they are met in a shuffle and never sent whole
    rows = overlap.m.counted_by_source(overlap._index(spark, d), overlap._near(spark, d))
    told = rows.join(inside.hint("merge"), ["doc_id", "source_doc", "idx"], "left")
    return told.select("doc_id", "source_doc", "idx", "source_idx", "n", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def page_ranges(spark, d):
    """Pages that hold a match of each submission, as compact ranges: 1-3, 5, 9-10 (ten sentences a page)."""
    pages = overlap._matched(spark, d).select("doc_id", (F.floor((F.col("idx") - 1) / 10) + 1).alias("page")).distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    runs = pages.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    listed = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", text.alias("r")))).alias("x"))
    return listed.select("doc_id", F.array_join(F.transform("x", lambda x: x["r"]), ", ").alias("pages"))


def string_hash(spark, d):
    """The 32-bit hash of each sentence (31 times the sum so far plus the UTF-16 unit), without its sign."""
    return overlap.st.sentences(overlap.documents(spark, d)).select("doc_id", "idx", tx.string_hash(F.col("clean_content")).alias("hash"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mean_ignoring_null, percent_formats, date_formats, file_names, page_number_lines, repeated_lines, heading_form, glued_row, numbering_split, retention_cascade,
        rename_nested, cascade_delete, rename_and_clamp, status_repair, teacher_scope, member_accounts, member_submissions, null_last_sort, identity_resolution,
        insert_defaults, roster_emails, passage_texts, patchwork_texts, source_drilldown, page_ranges, string_hash,
    )
}

_RUN = "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id"
_STATES = f"""states AS (SELECT c_custkey AS report, c_name AS title, c_nationkey AS class_id, ts,
  CASE WHEN user_id IS NULL THEN NULL WHEN event_type = 'error' THEN 0.0 WHEN value > 100 THEN 100.0 WHEN value < 0 THEN 0.0 ELSE value END AS ratio FROM customer LEFT JOIN ({_RUN}) ON user_id = c_custkey)"""
_BROKEN = r"string_split(regexp_replace(text, '(.{60,80}?) ', '\1' || chr(10), 'g'), chr(10))"
_PRINTED = rf"""raw AS (SELECT doc_id, {_BROKEN} AS lines FROM documents WHERE text IS NOT NULL), one AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM raw)"""
_FORMS = rf"""
shaped AS (SELECT doc_id, line_no, regexp_replace(substr(line, 1, 50), '[.!?,;:\s]+$', '') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
outlined AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {struct._SQUEEZED.format(x="CASE (line_no - 1) % 6 WHEN 0 THEN '1.' || line_no || ' ' || s WHEN 1 THEN 'IV. ' || s WHEN 2 THEN 'b) ' || s WHEN 3 THEN replace(upper(s), 'ß', 'SS') WHEN 4 THEN replace(s, ' ', 'Ô') ELSE '2.3Đ' || s END")} AS t FROM shaped)"""
_UP = r"length(regexp_replace(t, '[^\p{L}]|\p{Ll}', '', 'g'))"
_ALL = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
_SOURCES = "sources AS (SELECT l_orderkey AS submission, l_linenumber AS k, l_suppkey AS s FROM lineitem)"

ORACLES: dict[str, str] = {
    "mean_ignoring_null": f"WITH {_STATES} SELECT class_id, CASE WHEN count(ratio) > 0 THEN CAST((sum(CAST(floor(ratio * 10000 + 0.5) AS BIGINT)) + 50 * count(ratio)) // (100 * count(ratio)) AS BIGINT) END AS mean_x100, count(ratio) AS n FROM states GROUP BY class_id",
    "percent_formats": rf"WITH {_STATES} SELECT report, CASE WHEN ratio IS NULL THEN '0%' ELSE regexp_replace(printf('%.1f', floor(ratio * 10 + 0.5) / 10.0), '\.0$', '') || '%' END AS shown, printf('%.2f', floor(coalesce(ratio, 0.0) + 0.5) / 100) AS fraction FROM states",
    "date_formats": f"WITH {_STATES} SELECT report, coalesce(strftime(ts, '%d/%m/%Y %H:%M'), '--') AS shown FROM states",
    "file_names": r"""WITH named AS (SELECT page_id, list_last(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[^:]*://[^/]*', ''), '/'), lambda x: x <> '')) AS n FROM pages WHERE url IS NOT NULL),
clean AS (SELECT page_id, coalesce(regexp_replace(n, '[^\p{L}\p{N}._-]+', '_', 'g'), 'index') AS n FROM named)
SELECT page_id, CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\.[^.]*$', 1) ELSE n END AS stem, CASE WHEN contains(n, '.') THEN lower(list_last(string_split(n, '.'))) ELSE '' END AS ext FROM clean""",
    "page_number_lines": rf"WITH {_PRINTED}, numbers AS (SELECT doc_id, i // 20 + 1 AS p FROM one WHERE i % 20 = 0 AND i // 20 < 9999 UNION ALL SELECT doc_id, CAST(trim(line) AS BIGINT) FROM one WHERE regexp_matches(line, '^\s*[0-9]{{1,4}}\s*$')) SELECT doc_id, count(*) AS n_pages, CAST(max(p) AS INTEGER) AS last_page FROM numbers GROUP BY doc_id",
    "repeated_lines": rf"""WITH {_PRINTED}, full_ AS (SELECT doc_id, trim(line) AS line FROM one
  UNION ALL SELECT doc_id, trim('Report of ' || regexp_replace(substr(lines[1], 1, 30), '[.!?:;\s]+$', '')) FROM one WHERE i % 20 = 0 UNION ALL SELECT doc_id, CAST(i // 20 + 1 AS VARCHAR) FROM one WHERE i % 20 = 0)
SELECT doc_id, line, count(*) AS n FROM full_ WHERE line <> '' AND length(line) <= 80 AND right(line, 1) NOT IN ('.', '!', '?') GROUP BY ALL HAVING count(*) >= 3""",
    "heading_form": f"WITH {_FORMS} SELECT doc_id, line_no FROM outlined WHERE length(t) BETWEEN 4 AND 80 AND right(t, 1) NOT IN ('.', '!', '?', ',', ';', ':') AND {_ALL} >= 4 AND contains(t, ' ') AND 10 * {_UP} >= 7 * {_ALL}",
    "glued_row": rf"WITH {_FORMS} SELECT doc_id, line_no, md5(t) AS line_md5 FROM outlined WHERE length(t) >= 12 AND length(t) - length(regexp_replace(t, '\p{{Ll}}\p{{Lu}}', '_', 'g')) >= 2",
    "numbering_split": rf"""WITH {_FORMS}, split_ AS (SELECT doc_id, line_no, t, CASE WHEN regexp_matches(t, '^\d+([.,]\d+)*([.):]|[ ]|$)') THEN regexp_extract(t, '^\d+([.,]\d+)*[.):]?') WHEN regexp_matches(t, '(?i)^[ivxlcdm]+[.):]') THEN regexp_extract(t, '(?i)^[ivxlcdm]+[.):]')
  WHEN regexp_matches(t, '^[A-Za-zÀ-Ỹà-ỹ][.):]') THEN substr(t, 1, 2) WHEN regexp_matches(t, '^\d+([.,]\d+)+[A-ZÀ-Ỹ]') THEN regexp_extract(t, '^\d+([.,]\d+)+') END AS mark FROM outlined)
SELECT doc_id, line_no, mark, md5(trim(substr(t, CAST(length(mark) AS BIGINT) + 1))) AS rest_md5 FROM split_ WHERE mark IS NOT NULL""",
    "retention_cascade": f"""WITH {_STATES}, gone AS (SELECT report FROM states WHERE ts < TIMESTAMP '{EXPIRED}'),
hit AS (SELECT 'events' AS table_name, user_id IN (SELECT report FROM gone) AS g FROM events UNION ALL SELECT 'orders', o_custkey IN (SELECT report FROM gone) FROM orders UNION ALL SELECT 'customer', c_custkey IN (SELECT report FROM gone) FROM customer)
SELECT table_name, count(*) FILTER (NOT g) AS n_kept, count(*) FILTER (g) AS n_removed FROM hit GROUP BY table_name""",
    "rename_nested": f"WITH {_SOURCES} SELECT submission, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(CASE WHEN s % 10 = 3 AND s IN (SELECT s_suppkey FROM supplier) THEN s + 900000 ELSE s END AS VARCHAR), ',' ORDER BY k, s) AS sources FROM sources GROUP BY submission",
    "cascade_delete": f"WITH {_SOURCES}, kept AS (SELECT * FROM sources WHERE s NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) SELECT a.submission, CAST(count(kept.s) AS INTEGER) AS n, coalesce(string_agg(CAST(kept.s AS VARCHAR), ',' ORDER BY kept.k, kept.s), '') AS sources FROM (SELECT DISTINCT submission FROM sources) a LEFT JOIN kept USING (submission) GROUP BY a.submission",
    "rename_and_clamp": "SELECT event_id, CASE WHEN value > 100 THEN 100.0 WHEN value < 0 THEN 0.0 ELSE value END AS ratio, event_type AS kind, value NOT BETWEEN 0 AND 100 AS repaired FROM events",
    "status_repair": f"SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND ts >= TIMESTAMP '{EXPIRED}') THEN 'done' ELSE 'waiting' END AS status FROM orders WHERE o_orderstatus = 'F'",
    "teacher_scope": "SELECT s_suppkey AS teacher, count(DISTINCT n_nationkey) AS classes, count(DISTINCT c_custkey) AS members, count(DISTINCT o_orderkey) AS reports FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY s_suppkey",
    "member_accounts": "SELECT m.c_nationkey AS class_id, m.c_custkey + CASE WHEN m.c_custkey % 9 = 0 THEN 1000000 ELSE 0 END AS member, a.c_name AS account FROM customer m LEFT JOIN customer a ON a.c_custkey = m.c_custkey + CASE WHEN m.c_custkey % 9 = 0 THEN 1000000 ELSE 0 END",
    "member_submissions": f"""WITH {_STATES}, last AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey)
SELECT class_id, report AS member, o AS submission, CASE WHEN o IS NULL THEN NULL WHEN report % 4 > 0 THEN 'key' ELSE 'name' END AS found_by, round(ratio, 6) AS ratio FROM states LEFT JOIN last ON o_custkey = report""",
    "null_last_sort": f"WITH {_STATES} SELECT class_id, report, round(ratio, 6) AS ratio, CAST(row_number() OVER (PARTITION BY class_id ORDER BY ratio DESC NULLS LAST, report) AS INTEGER) AS down, CAST(row_number() OVER (PARTITION BY class_id ORDER BY ratio NULLS LAST, report) AS INTEGER) AS up FROM states",
    "identity_resolution": "SELECT c_name AS code, c_custkey AS user_id, 'student' AS role FROM customer UNION ALL SELECT s_name, s_suppkey, 'teacher' FROM supplier UNION ALL SELECT 'old ' || c_name, NULL, NULL FROM customer WHERE c_custkey % 10 = 0",
    "insert_defaults": "WITH ids AS (SELECT o_custkey AS id FROM orders UNION SELECT user_id * 2 FROM events) SELECT id, coalesce((SELECT c_mktsegment FROM customer WHERE c_custkey = id), 'NEW') AS segment, id NOT IN (SELECT c_custkey FROM customer) AS inserted FROM ids",
    "roster_emails": "SELECT lower(c_name) || '@school' AS email, CASE WHEN c_acctbal > 0 THEN c_custkey END AS account FROM customer",
    "passage_texts": overlap._with(overlap._INDEX + overlap._PASS, """SELECT p.doc_id, p.source_doc, t_from, s_from, md5(text) AS text_md5, md5(source_text) AS source_md5, CAST(length(text) AS INTEGER) AS n_chars FROM pass p,
LATERAL (SELECT string_agg(content, ' ' ORDER BY idx) AS text FROM idx_t t WHERE t.doc_id = p.doc_id AND t.idx BETWEEN t_from AND t_to) a,
LATERAL (SELECT string_agg(content, ' ' ORDER BY idx) AS source_text FROM idx_t t WHERE t.doc_id = p.source_doc AND t.idx BETWEEN s_from AND s_to) b"""),
    "patchwork_texts": overlap._with(overlap._INDEX + overlap._PATCH, "SELECT p.doc_id, t_from, md5(string_agg(content, ' ' ORDER BY t.idx)) AS text_md5, CAST(length(string_agg(content, ' ' ORDER BY t.idx)) AS INTEGER) AS n_chars FROM patch p JOIN idx_t t ON t.doc_id = p.doc_id AND t.idx BETWEEN t_from AND t_to GROUP BY p.doc_id, t_from"),
    "source_drilldown": overlap._with(overlap._INDEX + overlap._PATCH, """SELECT h.doc_id, h.source_doc, h.idx, min(h.source_idx) AS source_idx, count(*) AS n,
  EXISTS (SELECT 1 FROM pass p WHERE p.doc_id = h.doc_id AND p.source_doc = h.source_doc AND h.idx BETWEEN t_from AND t_to) AS in_passage,
  EXISTS (SELECT 1 FROM patch p JOIN pdet USING (doc_id, island) WHERE p.doc_id = h.doc_id AND source_doc = h.source_doc AND h.idx BETWEEN t_from AND t_to) AS in_patchwork
FROM hit h GROUP BY h.doc_id, h.source_doc, h.idx"""),
    "page_ranges": overlap._with(overlap._INDEX + overlap._MATCH, """SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM
(SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, (idx - 1) // 10 + 1 AS p FROM hit)) GROUP BY doc_id, g) GROUP BY doc_id"""),
    "string_hash": overlap._with(overlap._SENT, """SELECT doc_id, idx, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash FROM
(SELECT doc_id, idx, list_reduce(list_transform(string_split(clean_content, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM sent)"""),
}
