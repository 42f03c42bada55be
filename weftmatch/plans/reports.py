"""Report, class, rating, account and maintenance queries over application tables.

The tables at hand stand for the application's: ``customer`` are reports and students, ``supplier`` teachers, ``events`` check runs
(value: overlap ratio in percent) and ratings (stars ``1 + event_id % 5``), ``nation`` classes, ``orders`` submissions, whose
priority is the assignment, ``documents`` the texts.

Every query is declared once in SQL that Spark and DuckDB read alike; ``_SPARK`` and ``_DUCK`` hold the few functions whose
names differ. Ties always go to the larger id, and no query depends on the order of its input.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: the time that reports are made at, a parameter in use
NOW = "TIMESTAMP '2024-01-15 00:00:00'"

_SPARK = {"@split": "split", "@rows": "explode", "@list": "collect_list", "@has": "array_contains", "@len": "size", "@str": "STRING", "@all": "", "@bytes": "octet_length"}
_DUCK = {"@split": "string_split", "@rows": "unnest", "@list": "list", "@has": "list_contains", "@len": "len", "@str": "VARCHAR", "@all": ", 'g'", "@bytes": "strlen"}

#: latest check run of each report, ties by id
_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1"
#: reports with state: 2 scored, 1 failed (ratio 0), 0 in progress (no ratio)
_STATE = f"""SELECT c_custkey AS report, c_name AS title, c_nationkey AS class_id, event_type,
  CASE WHEN l.user_id IS NULL THEN 'Đang xử lý' WHEN event_type = 'error' THEN 'Lỗi' ELSE 'Đã xử lý' END AS state,
  CASE WHEN l.user_id IS NULL THEN NULL WHEN event_type = 'error' THEN 0.0 ELSE least(100.0, greatest(0.0, value)) END AS ratio
  FROM customer LEFT JOIN ({_LATEST}) l ON c_custkey = l.user_id"""
#: half-open ranges of percent
_BUCKETS = "(VALUES ('0-5', 0, 5), ('5-15', 5, 15), ('15-30', 15, 30), ('30-50', 30, 50), ('50+', 50, 1000)) AS b(code, lo, hi)"
_LEVEL = "CASE WHEN ratio IS NULL THEN NULL WHEN ratio >= 30 THEN 'high' WHEN ratio >= 15 THEN 'medium' ELSE 'low' END"
#: lines of the texts
_LINES = "SELECT trim(line) AS line FROM (SELECT @rows(@split(text, chr(10))) AS line FROM documents) x WHERE trim(line) <> ''"

SQL: dict[str, str] = {
    # lists of reports
    "report_list_latest": f"SELECT c.c_custkey AS report, coalesce(l.event_id, -1) AS run, l.value AS ratio, coalesce(n.runs, 0) AS runs FROM customer c LEFT JOIN ({_LATEST}) l ON c.c_custkey = l.user_id LEFT JOIN (SELECT user_id, count(*) AS runs FROM events GROUP BY user_id) n ON c.c_custkey = n.user_id",
    "status_case": f"SELECT report, state, ratio FROM ({_STATE}) s",
    "two_key_lookup": "SELECT k.id, coalesce(c.c_name, s.s_name, CAST(k.id AS @str)) AS name FROM (SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey + 100000 FROM supplier) k LEFT JOIN customer c ON c.c_custkey = k.id LEFT JOIN supplier s ON s.s_suppkey + 100000 = k.id",
    "scope_semi_join": f"SELECT report, class_id, ratio FROM ({_STATE}) s WHERE class_id IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)",
    "classes_of_user": "SELECT n.n_nationkey AS class_id, n.n_name AS class, s.s_name AS owner FROM nation n LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY s_nationkey) s ON n.n_nationkey = s.s_nationkey WHERE n.n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7) OR n.n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (7, 11))",
    "ne_or_missing": f"SELECT report, event_type FROM ({_STATE}) s WHERE event_type IS NULL OR event_type <> 'error'",
    "not_in_null_or_empty": "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND lang <> ''",
    "or_across_columns": "SELECT o_orderkey FROM orders WHERE o_custkey = 5 OR o_orderpriority = '1-URGENT' OR (o_orderstatus = 'F' AND o_totalprice > 200000)",
    "exists_column": "SELECT count(*) AS n_rows, count(lang) AS n_lang, count(text) AS n_text FROM documents",
    "date_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-12-31 00:00:00'",
    "anchored_codes": "SELECT c_custkey, substr(c_name, 10) AS code FROM customer WHERE c_name LIKE 'Customer#00000%' AND length(c_name) = 18",
    "nested_element": "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n, @list(o_orderstatus) AS states FROM orders GROUP BY o_custkey) x WHERE @has(states, 'P')",
    "defaults_projection": f"SELECT report, coalesce(ratio, 0.0) AS ratio, coalesce(event_type, '') AS kind, nullif(state, 'Lỗi') AS state FROM ({_STATE}) s",
    "assignment_state": f"SELECT o_orderkey, CASE WHEN {NOW} < o_orderdate THEN 'not-open' WHEN o_orderstatus = 'O' THEN 'open' WHEN {NOW} > o_orderdate + INTERVAL 2000 DAY THEN 'expired' ELSE 'open' END AS state FROM orders",
    "search_filter": f"SELECT report, title FROM ({_STATE}) s WHERE (contains(lower(title), lower('#0000001')) OR contains(lower(CAST(report AS @str)), '77')) AND state <> 'Lỗi'",
    "keyword_mark": "SELECT doc_id, regexp_replace(text, '(?i)(the)', '<mark>\\\\1</mark>'@all) AS marked FROM documents WHERE contains(lower(text), 'the')",
    "upload_admission": "SELECT doc_id, size, ext FROM (SELECT doc_id, CAST(@bytes(coalesce(text, '')) AS BIGINT) AS size, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'exe' ELSE 'txt' END AS ext FROM documents) x WHERE ext IN ('docx', 'pdf', 'txt') AND size <= 20 * 1024 * 1024 AND size > 0",
    # figures of a dashboard
    "kpi_cards": f"SELECT count(*) AS total, count(*) FILTER (WHERE state = 'Đã xử lý') AS scored, count(*) FILTER (WHERE state = 'Đã xử lý' AND ratio >= 30) AS over_threshold, count(*) FILTER (WHERE state = 'Lỗi') AS failed, count(*) FILTER (WHERE state = 'Đang xử lý') AS in_progress FROM ({_STATE}) s",
    "level_class": f"SELECT report, {_LEVEL} AS level FROM ({_STATE}) s",
    "range_bucket": f"SELECT s.report, b.code FROM ({_STATE}) s JOIN {_BUCKETS} ON s.ratio >= b.lo AND s.ratio < b.hi",
    "overlap_histogram": f"SELECT b.code, count(s.report) AS n, CAST(floor(100.0 * count(s.report) / (SELECT count(*) FROM ({_STATE}) t WHERE ratio IS NOT NULL) + 0.5) AS BIGINT) AS percent FROM {_BUCKETS} LEFT JOIN ({_STATE}) s ON s.ratio >= b.lo AND s.ratio < b.hi GROUP BY b.code",
    "ratio_by_counts": f"SELECT class_id, CAST(floor(1000.0 * count_if(state = 'Lỗi') / nullif(count(ratio), 0) + 0.5) AS BIGINT) AS failed_per_mille FROM ({_STATE}) s GROUP BY class_id",
    "group_multivalue": "SELECT label, count(*) AS students, CAST(sum(n) AS BIGINT) AS submissions, min(c_custkey) AS first_student FROM (SELECT @rows(@split(CASE WHEN c_custkey % 7 = 0 THEN '(Chưa cập nhật)' ELSE c_mktsegment || ',' || CAST(c_nationkey AS @str) END, ',')) AS label, c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey) x GROUP BY label",
    "class_by_year": "SELECT CAST(year(o_orderdate) AS INT) AS y, count(DISTINCT o_custkey) AS students, count(*) AS submissions FROM orders GROUP BY year(o_orderdate)",
    "distinct_values": "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL AND p_type <> ''",
    "scalar_counts": "SELECT (SELECT count(*) FROM customer) AS reports, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_runs, (SELECT count(*) FROM documents WHERE source NOT IN ('src0', 'src1')) AS samples",
    # order and pages
    "top20_sources": f"SELECT report, title, ratio FROM ({_STATE}) s ORDER BY ratio DESC NULLS LAST, lower(title), report LIMIT 20",
    "page_offset": "SELECT o_orderkey, o_totalprice, (SELECT CAST(floor((count(*) + 19) / 20) AS BIGINT) FROM orders) AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "group_label_sort": "SELECT label, row_number() OVER (ORDER BY CASE WHEN label = '(Chưa cập nhật)' THEN 1 ELSE 0 END, label) AS place FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN '(Chưa cập nhật)' ELSE c_mktsegment END AS label FROM customer) x",
    # ratings
    "rating_distribution": "SELECT b.stars, count(e.event_id) AS n, CAST(floor(1000.0 * count(e.event_id) / nullif((SELECT count(*) FROM events WHERE event_type = 'click'), 0) + 0.5) AS BIGINT) AS per_mille FROM (VALUES (5), (4), (3), (2), (1)) AS b(stars) LEFT JOIN events e ON e.event_type = 'click' AND 1 + e.event_id % 5 = b.stars GROUP BY b.stars",
    "rating_avg": "SELECT event_type, count(*) AS n, CAST(floor(avg(1 + event_id % 5) * 10 + 0.5) AS BIGINT) AS stars_x10 FROM events GROUP BY event_type",
    "rating_list": "SELECT e.event_id, 1 + e.event_id % 5 AS stars, coalesce(s.s_name, c.c_name, CAST(e.user_id AS @str)) AS reviewer FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id AND e.event_id % 3 = 0 LEFT JOIN customer c ON c.c_custkey = e.user_id",
    # classes, assignments, accounts
    "class_members": "SELECT c.c_nationkey AS class_id, c.c_custkey AS member FROM customer c LEFT ANTI JOIN (SELECT s_suppkey, s_nationkey FROM supplier) s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey WHERE c.c_mktsegment <> 'MACHINERY'",
    "same_person": "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON coalesce(nullif(c.c_custkey % 200, 0), c.c_custkey) = s.s_suppkey",
    "class_assignment_counts": "SELECT n.n_nationkey AS class_id, count(DISTINCT o.o_orderpriority) AS assignments, count(o.o_orderkey) AS submissions, count(DISTINCT o.o_custkey) AS submitters FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_nationkey",
    "assignment_submitted_missing": "SELECT a.class_id, a.assignment, m.members, a.submitted, greatest(0, m.members - a.submitted) AS missing FROM (SELECT c_nationkey AS class_id, o_orderpriority AS assignment, count(DISTINCT c_custkey) AS submitted FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority) a JOIN (SELECT c_nationkey AS class_id, count(*) AS members FROM customer GROUP BY c_nationkey) m ON a.class_id = m.class_id",
    "submitted_and_missing": "SELECT c_custkey AS student, 'submitted' AS state FROM customer LEFT SEMI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'missing' FROM customer LEFT ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey",
    "latest_submission": "SELECT student, assignment, submission FROM (SELECT o_custkey AS student, o_orderpriority AS assignment, o_orderkey AS submission, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) x WHERE k = 1",
    "account_stats": "SELECT c.c_custkey AS account, coalesce(a.n, 0) + coalesce(b.n, 0) AS reports, s.s_name AS teacher FROM customer c LEFT JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey) a ON a.id = c.c_custkey LEFT JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id) b ON b.id = c.c_custkey LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey",
    "reused_samples": "SELECT c_custkey AS report, o.o_custkey IS NOT NULL AS is_sample, e.ratio FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, max(value) AS ratio FROM events GROUP BY user_id) e ON e.user_id = c_custkey",
    "no_result": "SELECT c_custkey AS report FROM customer LEFT ANTI JOIN events ON user_id = c_custkey",
    "roster_valid": "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal > 0 END AS valid, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS registered FROM customer) x WHERE coalesce(valid, TRUE) AND coalesce(registered, TRUE)",
    # maintenance
    "dup_detect": "SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderkey) AS kept FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1",
    "dup_removed": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) x WHERE k > 1",
    "latest_per_key": f"SELECT user_id, event_id, event_type, value FROM ({_LATEST}) l",
    "retention_cut": f"SELECT event_id FROM events WHERE ts < {NOW} - INTERVAL 7 DAY AND event_type <> 'purchase'",
    "next_code": "SELECT 'KT' || lpad(CAST(max(CAST(substr(c_name, 10) AS BIGINT)) + 1 AS @str), 6, '0') AS code, max(CAST(substr(c_name, 10) AS BIGINT)) AS last_number FROM customer WHERE c_name LIKE 'Customer#%'",
    "role_sync": "SELECT c_custkey AS id, 'insert' AS action FROM customer LEFT ANTI JOIN supplier ON s_suppkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT s_suppkey, 'delete' FROM supplier LEFT ANTI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') b ON c_custkey = s_suppkey",
    "key_rename": "SELECT o.o_orderkey, coalesce(r.new_key, o.o_custkey) AS o_custkey FROM orders o LEFT JOIN (SELECT c_custkey AS old_key, c_custkey + 900000 AS new_key FROM customer WHERE c_custkey % 10 = 3) r ON o.o_custkey = r.old_key",
    "counter_refresh": "SELECT c_custkey, coalesce(n, 0) AS n_reports FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    # formats
    "code_formats": "SELECT c_custkey, 'SV' || lpad(CAST(c_custkey AS @str), 7, '0') AS student, 'BC' || CAST(c_custkey AS @str) AS report FROM customer",
    # lines by their form
    "prose_lines": f"SELECT CAST(length(line) AS BIGINT) AS size, count(*) AS n FROM ({_LINES}) l WHERE length(line) >= 150 AND right(line, 1) IN ('.', '!', '?') GROUP BY length(line)",
}


def _dialect(sql: str, words: dict[str, str]) -> str:
    for mark, name in words.items():
        sql = sql.replace(mark, name)
    return sql


def _spark_sql(sql: str) -> str:
    return _dialect(sql, _SPARK).replace("\\\\1</mark>", "$1</mark>")


def _duck_sql(sql: str) -> str:
    return _dialect(sql, _DUCK).replace("\\\\", "\\").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query ``name`` over the tables of a folder."""
    sql = _spark_sql(SQL[name])
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    for t in used:
        sql = re.sub(rf"(\{{{t}\}})(?= (?:LEFT|JOIN|ON|WHERE|GROUP|ORDER|UNION|\)|LIMIT)|\)|$)", rf"\1 AS {t}", sql)
    # other braces, of patterns, are no fields
    sql = re.sub(r"\\p\{(L[lu]?)\}", r"\\p{{\1}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, name) for name in SQL}
ORACLES: dict[str, str] = {name: _duck_sql(sql) for name, sql in SQL.items()}
