"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join.

A list entry is a canonical host and a path that begins with ``/``; it covers the host, all its subdomains and every
path that begins with its own, and carries a verdict. Entries are rules or plain listings. Of the rules that fit a URL
the longest wins (host and path together, then the longer host); without one, the longest listing that fits; without
that, the verdict is ``default``.

Rules fit host and path as they stand. Listings, and URLs that are looked up among them, are brought to a canonical form: the host
without user name, port and final dots, in lower case; codes like ``%7e`` of letters, figures and ``-._~`` as the character,
other codes in upper case; an empty path as ``/``. Codes are decoded once; dot segments and names in other scripts stay.

Every URL is looked up under all pairs of a host suffix and a path prefix of a length that some entry has. A key first
asks the filter: its hash picks one block of 512 bits and eight bits in it. Blocks are built by bitwise aggregation and
broadcast, at most ``MAX_BYTES`` (about 16 bits an entry; beyond that size more keys pass, and nothing else changes).
Keys that pass are joined exactly with the list, which removes all false hits.

Defined results: host and path are '' for a null URL or one without ``://``; such rows get the default verdict. Rows
are judged one by one, whatever repeats. Of entries that differ in verdict alone the last in order (block before allow) counts; those
without host are passed over. An empty list gives every row the default; an empty table an empty table. Further columns do not come along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textnum import mix

MAX_BYTES = 64 << 20
_WORDS = 8  # 64-bit words of a block
#: hex codes of letters, figures and ``-._~``
UNRESERVED = "^(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"


def host(url: Column) -> Column:
    """Host of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _decoded(part: Column) -> Column:
    """Percent codes of unreserved characters as the character, other codes in upper case."""

    def behind(s: Column, i: Column) -> Column:
        code = F.upper(F.substring(s, 1, 2))
        rest = F.substring(s, 3, 1 << 30)
        plain = F.concat(F.decode(F.unhex(code), "UTF-8"), rest)
        return F.when(i == 0, s).when(s.rlike(UNRESERVED), plain).when(s.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%"), s))

    return F.when(part.contains("%"), F.array_join(F.transform(F.split(part, "%"), behind), "")).otherwise(part)


def canonical(h: Column, p: Column) -> tuple[Column, Column]:
    """Canonical form of a host (as ``host`` gives it) and a path."""
    bare = F.regexp_replace(F.regexp_replace(h, "(?s)^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(_decoded(bare)), r"\.+$", ""), F.when(p == "", F.lit("/")).otherwise(_decoded(p))


def _key(h: Column, p: Column) -> Column:
    return F.xxhash64(h, p)


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key and its 8 bits in it."""
    x = mix(keys.view(np.uint64))
    block = (x >> np.uint64(20)) % np.uint64(blocks)
    y = mix(x + np.uint64(1))
    bits = np.stack([(y >> np.uint64(6 * i)) & np.uint64(63) for i in range(_WORDS)], axis=1)
    return block.astype(np.int64), bits


def build_filter(keys: DataFrame) -> np.ndarray:
    """The filter of the column ``key``: an array of blocks, each of eight 64-bit words with one bit a key in each."""
    n = keys.count()
    blocks = max(1, min(MAX_BYTES // 64, 1 << max(0, (16 * n // 512)).bit_length()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            block, bits = _places(part.column("key").to_numpy(), blocks)
            words = (np.uint64(1) << bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, i]) for i in range(_WORDS))], names=["block", *(f"w{i}" for i in range(_WORDS))])

    rows = keys.select("key").mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(_WORDS)))
    found = rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)]).toPandas()
    out = np.zeros((blocks, _WORDS), np.uint64)
    out[found["block"].to_numpy(np.int64)] = found[[f"w{i}" for i in range(_WORDS)]].to_numpy(np.int64).view(np.uint64)
    return out


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    block, bits = _places(keys, len(table))
    return ((table[block] >> bits) & np.uint64(1)).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule), verdict; ``listed`` has host, path, verdict and is_rule."""
    spark = pages.sparkSession
    own = listed.where("host IS NOT NULL AND host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict", F.coalesce("is_rule", F.lit(False)).alias("is_rule"))
    listed_host, listed_path = canonical(F.col("host"), F.col("path"))
    own = own.withColumns({"host": F.when(F.col("is_rule"), F.col("host")).otherwise(listed_host), "path": F.when(F.col("is_rule"), F.col("path")).otherwise(listed_path)})
    entries = stored(own.groupBy("host", "path", "is_rule").agg(F.max("verdict").alias("verdict")).withColumn("key", _key(F.col("host"), F.col("path"))), "listed")
    sizes = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())
    sent = spark.sparkContext.broadcast(build_filter(entries))
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url).cast("string")).alias("host"), path(F.col(url).cast("string")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "urls")
    # a URL that is canonical already, as most are, is looked up once
    plain_host, plain_path = canonical(F.col("host"), F.col("path"))
    forms = rows.where("host <> ''").select("row", "host", "path", plain_host.alias("host_"), plain_path.alias("path_"))
    form = lambda h, p, rules: F.struct(F.col(h).alias("host"), F.col(p).alias("path"), F.lit(rules).cast("boolean").alias("rules"))
    same = F.array(form("host", "path", None))
    looked = F.when((F.col("host") == F.col("host_")) & (F.col("path") == F.col("path_")), same).otherwise(F.array(form("host", "path", True), form("host_", "path_", False)))
    looked = forms.select("row", F.inline(looked))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    keyed = looked.select("row", "rules", F.explode(suffixes).alias("h"), "path", prefixes.alias("sizes")).select("row", "rules", "h", "path", F.explode("sizes").alias("size"))
    keyed = keyed.select("row", "rules", "h", F.expr("substring(path, 1, size)").alias("p")).withColumn("key", _key(F.col("h"), F.col("p")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(passes(sent.value, part.column("key").to_numpy())))

    possible = keyed.mapInArrow(run, keyed.schema)
    exact = possible.join(entries.withColumnsRenamed({"host": "h", "path": "p"}).drop("key"), ["h", "p"]).where("rules IS NULL OR rules = is_rule")
    order = F.struct("is_rule", (F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"), F.concat("h", "p").alias("rule"), "verdict")
    best = exact.groupBy("row").agg(F.max(order).alias("best")).withColumnRenamed("row", "row_")
    out = rows.join(best, F.col("row") == F.col("row_"), "left")
    return out.select("page_id", "host", "path", F.when(F.col("best.is_rule"), F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
