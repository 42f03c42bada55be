"""Lines of printed pages: running headers and page numbers go, lines broken at the page's width come together."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lines as ln
from .regions import BEGINS, FULL_LINE, GOES_ON, _folded, _joined, _normal

#: fixed values: how often a line comes back in one text, and its longest length
REPEATS, LONGEST = 3, 80


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _repeated(rows: pa.Array) -> pa.Array:
    out = []
    for keys in rows.to_pylist():
        n = Counter(k for k in keys or () if k is not None)
        out.append(None if keys is None else [k is not None and n[k] >= REPEATS for k in keys])
    return pa.array(out, pa.list_(pa.bool_()))


def without_page_marks(docs: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds ``name``: ``lines`` squeezed, without blank lines, page numbers and running headers.

    A running header is a line of at most 80 characters that does not end a sentence and comes three times or more in its text."""
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.translate(x, "\f\r�", "   "), r"[\t \x{E000}-\x{F8FF}]+", " ")))
    full = docs.withColumn("tidy_", F.filter(tidy, lambda x: (x != "") & ~ln.is_page_number(x)))
    keys = F.transform("tidy_", lambda x: F.when((F.length(x) <= LONGEST) & ~x.rlike("[.!?]$"), x))
    marked = full.withColumn("repeated_", _repeated(keys))
    kept = F.filter(F.zip_with("tidy_", "repeated_", lambda x, r: F.when(~r, x)), lambda x: x.isNotNull())
    return marked.withColumn(name, kept).drop("tidy_", "repeated_")


def _width_flags(lines: Column) -> Column:
    def of(line: Column, x: Column) -> Column:
        heading = ln.is_heading(x) | (F.coalesce(ln.label_of(line), F.lit("")) == ln.HEADING)
        opens = heading | ln.is_caption(x) | line.rlike(r"^\d+(?:[.,]\d+)*\s*[.)]?\s") | line.rlike("^[-–—+*•·▪●○◦>»]") | line.rlike(r"(?iu)^(bước|câu|ví\s*dụ|lưu\s*ý|chú\s*ý)\s*\d*\s*[:.]")
        return F.struct(
            F.length(line).alias("size"), line.rlike(r"[.!?:;]\s*$").alias("closed"), opens.alias("opens"),
            (heading | ln.is_contents_line(x)).alias("apart"), ln.label_of(line).isNotNull().alias("labelled"),
        )

    return F.zip_with(lines, _normal(lines), of)


def fold_widths(flags: list[dict]) -> list[int]:
    """A line goes on where the one before is open and fills a line, and neither is a heading, an entry or labelled."""
    out, size, before = [], 0, None
    for x in flags:
        if before and not before["closed"] and not before["apart"] and not before["labelled"] and size >= FULL_LINE and not x["opens"] and not x["labelled"]:
            out.append(GOES_ON)
            size += 1 + x["size"]
            # what began the paragraph decides whether it is a heading, its last line whether it is closed
            before = {**before, "closed": x["closed"]}
        else:
            out.append(BEGINS)
            size, before = x["size"], x
    return out


def join_widths(docs: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds ``name``: the lines with those that a page's width broke put together."""
    coded = docs.withColumn("codes_", _folded(_width_flags(F.col(lines)), fold_widths, "array<int>"))
    return coded.withColumn(name, _joined(F.col(lines), F.col("codes_"))).drop("codes_")
