"""Reports in folders: the folder is the kind of a report, the file's name without its ending the title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: endings whose files hold plain text
PLAIN = ("txt", "text", "md")


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = (*PLAIN, "docx", "pdf")) -> DataFrame:
    """kind, title, ending, path, n_bytes, modified, text of every file below ``root`` with one of ``endings``.

    Files are read by the tasks, each whole. Text is UTF-8 without its byte order mark; bytes that are none come out as replacement signs. It is
    null for other kinds of files. A file directly in ``root`` has no kind. Files and folders whose names begin with ``_`` or ``.`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # names come percent-coded, as parts of an address
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\+", "%2B"))
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    below = F.url_decode(F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), r"\+", "%2B"))
    folder = F.when(F.endswith(below, F.lit("/" + base)), None).otherwise(F.regexp_extract(below, "([^/]*)$", 1))
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    plain = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    told = files.select(folder.alias("kind"), F.trim(F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), ending.alias("ending"), "path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.when(ending.isin(*PLAIN), plain).alias("text"))
    return told.where(F.col("ending").isin(*endings))
