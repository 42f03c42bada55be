"""Tables that outlive a query: materialised intermediates, replacement by key, workbooks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_known: dict[tuple[str, str, str], tuple[str, str]] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; where it is unset, a temporary one if Spark runs in
    one process (tests), else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or "file://" + tempfile.mkdtemp(prefix="weftmatch-")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table."""
    where, fs = _path(spark, path)
    return repr(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)))


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """While a table is written, its shuffle files go as soon as it stands."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialised(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame | Iterable[DataFrame]], settings: str = "") -> DataFrame:
    """The table ``name`` over the table in ``source``, built and written once in a session and read by every query after that.

    ``build`` may give it in several parts; the shuffle files of one are gone before the next is made. It is built anew, and the old
    one deleted, when the files of the source or the settings have changed."""
    key = (spark.sparkContext.applicationId, source, name)
    state = _files(spark, source) + settings
    before = _known.get(key)
    if before is None or before[1] != state:
        path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        built = build()
        for part in [built] if isinstance(built, DataFrame) else built:
            with _shuffles_cleaned(spark):
                part.write.mode("append").option("compression", "zstd").parquet(path)
        _known[key] = (path, state)
        if before is not None:
            where, fs = _path(spark, before[0])
            fs.delete(where, True)
    return spark.read.parquet(_known[key][0])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def sheet_rows(df: DataFrame, sheet: str, order: list[str]) -> DataFrame:
    """One XML row of a SpreadsheetML sheet per row of ``df``, in the sheet's order; a null is an empty cell. Written with ``write.text``."""
    number = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    cells = [F.coalesce(F.concat(F.lit(f'<Cell><Data ss:Type="{"Number" if c in number else "String"}">'), clean(c), F.lit("</Data></Cell>")), F.lit("<Cell/>")) for c in df.columns]
    return df.orderBy(*order).select(F.lit(escape(sheet)).alias("sheet"), F.concat(F.lit("<Row>"), *cells, F.lit("</Row>")).alias("value"))


#: fixed values: what stands around the sheets of a SpreadsheetML workbook
_BOOK = ('<?xml version="1.0" encoding="UTF-8"?>', '<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">', "</Workbook>")


def workbook(sheets: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """The lines of a workbook: each sheet (name, rows, order) with a row of titles and its rows in order.

    The rows of a sheet are sorted by ranges and never come together in one place. Written with ``write.text``, the parts in order
    of their names are the file."""
    spark = sheets[0][1].sparkSession
    lines = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    out = lines(*_BOOK[:2])
    for name, df, order in sheets:
        titles = "".join(f'<Cell><Data ss:Type="String">{escape(c)}</Data></Cell>' for c in df.columns)
        out = out.union(lines(f'<Worksheet ss:Name="{escape(name)}"><Table>', f"<Row>{titles}</Row>")).union(sheet_rows(df, name, order).select("value")).union(lines("</Table></Worksheet>"))
    return out.union(lines(_BOOK[2]))
