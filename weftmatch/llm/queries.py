"""The dealt operators as queries over a folder of tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, exponion, jaccard_join, langid, line_dedup, packing, periodic, pieces, quality_rules, token_counts, token_files, toxicity, url_filter
from .shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_mod(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _crc_mod(4) == 2)
    model = langid.fit(docs.where("NOT held_out").select("doc_id", "text", "lang"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "failed_bits",
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), percent=85, words=4).select("doc_id", "n_shingles", "component_id", "class_id")


def tokenizer(name: str) -> str:
    """The file of a public tokenizer, installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), line_dedup.FULL).select("doc_id", "n_lines", "n_removed", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _crc_mod(3) == 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where("NOT held_out"), labels)
    found = toxicity.score(docs, model, ["doc_id", "held_out"], spans=True)
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), n_best=4)


#: fixed values: the rules of the contract, and listed sites
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URL_SITES = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
URL_DOMAINS = ["example.com", "example.net", "example.org"]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = [(f"{site}.{domain}", "/", "block", False) for site in URL_SITES for domain in URL_DOMAINS]
    listed = spark.createDataFrame([(*r, True) for r in URL_RULES] + listings, "host string, path string, verdict string, is_rule boolean")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed)


def _decoded_sql(part: str) -> str:
    """SQL of the canonical percent codes of a host or path."""
    return (
        f"array_to_string(list_transform(string_split({part}, '%'), lambda s, i: CASE WHEN i = 1 THEN s WHEN regexp_matches(s, '{url_filter.UNRESERVED}') THEN chr(('0x' || s[1:2])::INT) || substr(s, 3)"
        " WHEN regexp_matches(s, '^[0-9A-Fa-f]{{2}}') THEN '%' || upper(s[1:2]) || substr(s, 3) ELSE '%' || s END), '')"
    )


OP10_SQL = ("""
WITH rules(h, p, v) AS (VALUES {rules}), sites(s) AS (VALUES {sites}),
as_is AS (
  SELECT page_id, row_number() OVER () AS row_no,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS b FROM as_is),
u AS (SELECT *, regexp_replace(lower(""" + _decoded_sql("b") + """), '\\.+$', '') AS site FROM bare),
hit AS (
  SELECT row_no, h || p AS rule, v, row_number() OVER (PARTITION BY row_no ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, hit.rule,
  CASE WHEN hit.v IS NOT NULL THEN hit.v
       WHEN EXISTS (SELECT 1 FROM sites WHERE u.site = s OR ends_with(u.site, '.' || s)) THEN 'block'
       ELSE 'allow' END AS verdict
FROM u LEFT JOIN hit ON u.row_no = hit.row_no AND hit.k = 1
""").format(rules=", ".join(str(r) for r in URL_RULES), sites=", ".join(f"('{s}.{d}')" for s in URL_SITES for d in URL_DOMAINS))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: one text in ten, by h = crc32 of doc_id, is periodic from word a on (see the contract of operator 11)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.expr("filter(split(text, '[ \\\\x09-\\\\x0D]+'), w -> w <> '')"))
    placed = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    split = placed.withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("concat_ws(' ', slice(words, 1, int(a)), transform(sequence(a, n - 1), i -> words[int(a + (i - a) % p)]))")
    return split.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "r.start", (-F.col("r.less")).alias("length"), "r.period", F.expr("1000 * -r.less div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.sequences(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, centroids = exponion.cluster(table(spark, sf_dir, "embeddings"))
    own = vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    digest = centroids.select("cluster", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))
    # a row for each of 16 clusters
    return vectors.join(F.broadcast(own.join(digest, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
a{i} AS (
  SELECT r, min({{'d': d, 'c': c}}) AS near FROM (
    SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{i} c
  ) GROUP BY r
),
"""
_MEANS = """
m{i} AS (
  SELECT c, list(CAST(floor_div AS BIGINT) ORDER BY k) AS x FROM (
    SELECT near.c AS c, k, (sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM a{i} JOIN v USING (r), range(1, 65) AS ks(k) GROUP BY ALL
  ) GROUP BY c
),
c{j} AS (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c)),
"""
OP13_SQL = (
    """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
),
c0 AS (SELECT c - 1 AS c, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) AS c, x FROM v) WHERE c <= 16),
"""
    + "".join(_ROUND.format(i=i) + _MEANS.format(i=i, j=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
s AS (SELECT near.c AS c, sum(near.d) AS own FROM a3 GROUP BY near.c)
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance, CAST(own AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(own) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN s ON s.c = near.c JOIN c3 ON c3.c = near.c
"""
)

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_exponion": op13_exponion,
}

ORACLES: dict[str, str] = {"op10_url_filter": OP10_SQL, "op13_exponion": OP13_SQL}
