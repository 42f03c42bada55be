"""Which lines of a report are its body, and which lines belong together.

What a line is, is decided by column expressions within the row of its document. What depends on the lines before it is a fold
over these flags: a small loop in an Arrow function that takes flags in and gives a code for each line back, in linear time and
without a shuffle. A text lies in one row, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln

COVER, SKIPPED, BODY = "cover", "skipped", "body"
#: fixed value: lines after which prose ends a block that is left out
MOST_SKIPPED = 40
#: fixed values: lines that a heading without a name takes in, and the length from which an open line goes on in the next
MOST_JOINED, FULL_LINE = 3, 60


def _folded(flags: Column, fold: Callable[[list[dict]], list], kind: str) -> Column:
    of = pa.list_(pa.string() if kind == "array<string>" else pa.int32())

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if row.as_py() is None else fold(row.as_py()) for row in rows], of)

    return run(flags)


# --- regions


def _normal(lines: Column) -> Column:
    return F.transform(lines, lambda x: ln.normal(x))


def _region_flags(lines: Column, normal: Column) -> Column:
    def of(line: Column, t: Column) -> Column:
        label = F.coalesce(ln.label_of(line), F.lit(""))
        contents = ln.is_contents_line(t)
        heading = ~contents & ~ln.is_profile(t) & ((label == ln.HEADING) | ln.is_heading(t))
        block = t.rlike(ln.one_of(ln.BLOCK_HEADINGS, rf"(?:{'|'.join(ln.BLOCK_PREFIXES)})?\s*"))
        return F.struct(
            ((t == "") | ln.is_page_number(t)).alias("blank"), (label == ln.CONTENTS).alias("listed"), contents.alias("contents"), ln.is_prose(t).alias("prose"),
            F.when(heading & block, SKIPPED).when(heading, BODY).alias("opens"), (ln.is_chapter(t) | t.rlike(ln.one_of(ln.BODY_HEADINGS))).alias("named"),
            t.rlike(ln.one_of(ln.TO_THE_END, after="")).alias("to_end"), t.rlike(ln.one_of(ln.NAMES_ONLY, after="")).alias("names"),
        )

    return F.zip_with(lines, normal, of)


def fold_regions(flags: list[dict]) -> list[str]:
    """For each line: cover, skipped or body. A heading opens a region and stays with the body if it opens that."""
    out, region, to_end, contents, skipped, entries = [], COVER, False, False, 0, False
    for x in flags:
        here = SKIPPED if region == BODY else region
        if x["blank"]:
            pass
        elif x["listed"]:
            contents, entries, skipped = True, True, skipped + 1
        elif x["opens"]:
            if region == COVER and x["opens"] == BODY and not x["named"]:
                pass  # a cover is full of lines that look like headings
            elif contents and x["opens"] == BODY and not entries:
                # a list of contents that has shown no entry yet: this is one, and the next heading opens the body
                entries, skipped = True, skipped + 1
            else:
                region, skipped = x["opens"], 0
                to_end, contents = region == SKIPPED and x["to_end"], region == SKIPPED and x["names"]
                here = region
        else:
            if x["prose"] and (region == COVER or contents or (region == SKIPPED and not to_end and skipped >= MOST_SKIPPED)):
                region, contents = BODY, False
            if region != BODY:
                entries, skipped = entries or contents, skipped + 1
                here = region
            else:
                here = SKIPPED if x["contents"] else BODY
        out.append(here)
    return out


def with_regions(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds ``regions`` (for each line) and ``compared`` (numbers from 1 of the lines that are compared).

    Compared is the body after its opening heading, or else after chapter or part one, or else the whole body; and all
    lines where there is no body, as too much is better than an empty report."""
    told = docs.withColumn("normal_", _normal(F.col(lines)))
    flagged = told.withColumn("regions", _folded(_region_flags(F.col(lines), F.col("normal_")), fold_regions, "array<string>"))
    places = F.sequence(F.lit(1), F.size(lines))
    body = F.filter(F.when(F.size(lines) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.element_at("regions", i) == BODY)

    def first(pattern: str) -> Column:
        t = lambda i: F.element_at("normal_", i)
        return F.array_min(F.filter("body_", lambda i: t(i).rlike(pattern) & ~ln.is_contents_line(t(i))))

    opening = first(ln.one_of(ln.OPENINGS, f"(?:{ln.NUMBERED})?"))
    chapter = first(ln.CHAPTER + r"\s*[:\-–]?\s*(1|I)(?![\p{L}\p{N}])")
    found = flagged.withColumn("body_", body).withColumn("mark_", F.coalesce(opening, chapter, F.lit(0)))
    after = F.filter("body_", lambda i: i > F.col("mark_"))
    compared = F.when(F.size("body_") == 0, F.when(F.size(lines) > 0, places)).when(F.size(after) == 0, F.col("body_")).otherwise(after)
    return found.withColumn("compared", F.coalesce(compared, F.array().cast("array<int>"))).drop("body_", "mark_", "normal_")


# --- joined lines: 0 begins a line, 1 goes on with the line before, 2 goes

BEGINS, GOES_ON, GOES = 0, 1, 2


def _heading_flags(lines: Column) -> Column:
    def of(trimmed: Column, x: Column) -> Column:
        unnamed = rf"(?iu)^(CHƯƠNG|CHUONG|PHẦN|PHAN|CHAPTER|PART)\s*[:\-–]?\s*(\d+|[IVXLCDM]+)\s*[:.\-–]?$"
        letters = F.regexp_replace(x, r"[^\p{L}]", "")
        large = F.length(letters) - F.length(F.regexp_replace(letters, r"[^\p{Ll}]", ""))
        goes_on = (x != "") & (F.length(x) <= 100) & ~x.rlike("[.!?;,]$") & (letters != "") & ((letters == F.upper(letters)) | x.rlike(r"^\p{Lu}"))
        contents = ln.is_contents_line(x)
        heading = ln.is_heading(x) | (F.coalesce(ln.label_of(trimmed), F.lit("")) == ln.HEADING)
        return F.struct(
            (trimmed == "").alias("empty"), ln.is_page_number(trimmed).alias("page"), (goes_on & ~contents).alias("part"),
            ((F.length(letters) >= 3) & (10 * large >= 9 * F.length(letters))).alias("capitals"), (heading & ~contents & x.rlike(unnamed)).alias("open"),
        )

    return F.zip_with(F.transform(lines, lambda x: F.trim(x)), _normal(lines), of)


def fold_headings(flags: list[dict]) -> list[int]:
    """A chapter that has a number and no name takes in up to three lines: any that looks like a name, then capitals only; page numbers between go."""
    out, taken = [], None
    for x in flags:
        if taken is not None and taken < MOST_JOINED:
            if x["page"]:
                out.append(GOES)
                continue
            if x["part"] and (not taken or x["capitals"]):
                out.append(GOES_ON)
                taken += 1
                continue
        out.append(GOES if x["empty"] else BEGINS)
        taken = 0 if x["open"] and not x["empty"] else None
    return out


def is_new_item(t: Column) -> Column:
    """A caption with a sign after its number, or a numbered heading: never the rest of the line before."""
    return t.rlike(ln.CAPTION_START) | (t.rlike(r"^\d+(\.\d+)+\.?\s+\p{Lu}\p{Ll}") & (F.length(t) <= 80) & ~t.rlike("[.!?;]$"))


def _sentence_flags(lines: Column) -> Column:
    def of(t: Column, x: Column) -> Column:
        heading = ln.is_heading(x) | (F.coalesce(ln.label_of(t), F.lit("")) == ln.HEADING)
        return F.struct(
            F.length(t).alias("size"), t.rlike("[.!?:;]$").alias("closed"), t.rlike(r"^\p{Ll}").alias("small"),
            (heading | t.rlike(ln.BULLET) | ln.is_contents_line(x) | is_new_item(t)).alias("apart"),
        )

    return F.zip_with(F.transform(lines, lambda x: F.trim(x)), _normal(lines), of)


def fold_sentences(flags: list[dict]) -> list[int]:
    """A line goes on with the one before if that is open and this begins small, or if that, with what it took in, fills a line."""
    out, size, closed = [], 0, True
    for x in flags:
        if not x["size"]:
            out.append(GOES)
            continue
        if size and not closed and not x["apart"] and (x["small"] or size >= FULL_LINE):
            out.append(GOES_ON)
            size += 1 + x["size"]
        else:
            out.append(BEGINS)
            size = x["size"]
        closed = x["closed"]
    return out


def _joined(lines: Column, codes: Column) -> Column:
    """Lines put together as the codes say; linear in the text."""
    parts = F.zip_with(lines, codes, lambda x, c: F.when(c == GOES, "").otherwise(F.concat(F.when(c == GOES_ON, " ").otherwise("\n"), F.trim(x))))
    return F.filter(F.split(F.array_join(parts, ""), "\n"), lambda x: x != "")


def join_headings(docs: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds the column ``name``: the array ``lines`` with chapters and their names on one line."""
    coded = docs.withColumn("codes_", _folded(_heading_flags(F.col(lines)), fold_headings, "array<int>"))
    return coded.withColumn(name, _joined(F.col(lines), F.col("codes_"))).drop("codes_")


def join_sentences(docs: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds the column ``name``: the array ``lines`` with sentences broken over lines put together."""
    coded = docs.withColumn("codes_", _folded(_sentence_flags(F.col(lines)), fold_sentences, "array<int>"))
    return coded.withColumn(name, _joined(F.col(lines), F.col("codes_"))).drop("codes_")


def unlabelled(lines: Column) -> Column:
    """Without the lines that the reader declares as captions, table cells or text boxes."""
    return F.filter(lines, lambda x: ~F.coalesce(ln.label_of(x).isin(ln.CAPTION, ln.TABLE, ln.TEXT_BOX), F.lit(False)))


def prepared(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds ``content``: the lines that are compared, headings joined, side parts left out; labels of headings and contents stay."""
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[\\t ]", " "), " {2,}", " ")))
    joined = with_regions(join_headings(docs.withColumn("tidy_", unlabelled(tidy)), "tidy_", "joined_"), "joined_")
    kept = F.transform("compared", lambda i: F.element_at("joined_", i))
    return joined.withColumn("content", kept).drop("tidy_", "joined_", "regions", "compared")
