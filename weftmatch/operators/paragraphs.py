"""Paragraphs of printed pages, rebuilt from where their lines stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.text import floor_percentile
from .regions import _folded, is_new_item

#: fixed values: lines from this length on tell the edges of a page, which are a tenth and nine tenths of theirs; the share of a page's width
#: within which a line reaches the right edge, the indent in points and the multiple of the usual gap that begin a paragraph; the usual gap
#: where there is none; the share of a page's height at either end for headers and footers, which are narrower than the other share of its width
EDGE_CHARS, LEFT, RIGHT, REACH, INDENT, GAP, USUAL, BAND, NARROW = 40, 0.1, 0.9, 0.04, 4.0, 1.45, 20.0, 0.045, 0.6
#: fixed value: signs of a list item that was typed
ITEM = r"^(?:[-–—•●○◦▪■□❖➢➣➤✓✔+*>»·]|\d+[.)]|[a-zđ][.)])\s"
BEGINS, GOES_ON, ASIDE, IN_TABLE = 0, 1, 2, 3


def with_edges(docs: DataFrame, lines: str) -> DataFrame:
    """Adds ``gap`` (the usual distance of lines in a document) and ``edges`` (page, left, right), each from values that occur.

    ``lines`` is an array in reading order of page, page_height, y (upwards), x0, x1, text, in_table."""
    x = F.col(lines)
    steps = F.transform(x, lambda r, i: F.when((i > 0) & (F.get(x, i - 1)["page"] == r["page"]), F.get(x, i - 1)["y"] - r["y"]))
    gaps = F.filter(steps, lambda g: F.coalesce(g > 0, F.lit(False)))

    def edge(page: Column) -> Column:
        own = F.filter(x, lambda r: r["page"] == page)
        long = F.filter(own, lambda r: F.length(r["text"]) >= EDGE_CHARS)
        told = F.when(F.size(long) > 0, long).otherwise(own)
        return F.struct(page.alias("page"), floor_percentile(F.transform(told, lambda r: r["x0"]), LEFT).alias("left"), floor_percentile(F.transform(told, lambda r: r["x1"]), RIGHT).alias("right"))

    pages = F.array_distinct(F.transform(x, lambda r: r["page"]))
    usual = F.when(F.size(gaps) > 0, floor_percentile(gaps, 0.5)).otherwise(USUAL)
    return docs.withColumn("gap", usual).withColumn("edges", F.map_from_entries(F.transform(pages, lambda p: F.struct(p, edge(p)))))


def _flags(lines: Column) -> Column:
    def of(r: Column) -> Column:
        e = F.element_at(F.col("edges"), r["page"])
        wide = F.greatest(e["right"] - e["left"], F.lit(1.0))
        outer = (r["page_height"] > 0) & ((r["y"] > r["page_height"] * (1 - BAND)) | (r["y"] < r["page_height"] * BAND))
        letter = (r["x1"] - r["x0"]) / F.greatest(F.length(r["text"]), F.lit(1))
        begins = r["text"].rlike(ln.CAPTION_START)
        return F.struct(
            r["page"].alias("page"), r["y"].alias("y"), r["x0"].alias("x0"), r["x1"].alias("x1"), e["right"].alias("right"), (wide * REACH).alias("reach"), F.col("gap").alias("gap"),
            (letter * (F.length(F.element_at(F.split(r["text"], " "), 1)) + 1)).alias("word"), r["text"].rlike(ITEM).alias("item"), is_new_item(r["text"]).alias("opens"),
            ((outer & (r["x1"] - r["x0"] < wide * NARROW)) | ln.is_page_number(r["text"])).alias("aside"), F.coalesce(r["in_table"], F.lit(False)).alias("table"),
            begins.alias("caption"), r["text"].rlike(r"^\d+(\.\d+)+\.?\s+\p{Lu}\p{Ll}").alias("numbered"), r["text"].rlike("[.!?;]$").alias("closed"), F.length(r["text"]).alias("size"),
        )

    return F.transform(lines, of)


def fold_paragraphs(flags: list[dict]) -> list[int]:
    """For each line the number of the paragraph it belongs to, in order of output; headers met within a paragraph come after it."""
    out, last, number, given = [], None, 0, 0
    for x in flags:
        if x["aside"]:
            given += 1
            out.append(given)
            continue
        if x["table"]:
            given += 1
            out.append(given)
            last = None
            continue
        if last:
            full = last["x1"] >= last["right"] - x["reach"] or last["x1"] + x["word"] > last["right"]
            title = last["caption"] or (last["numbered"] and last["size"] <= 80 and not last["closed"])
            near = last["page"] != x["page"] or last["y"] - x["y"] <= x["gap"] * GAP
            if full and not x["item"] and not x["opens"] and not title and x["x0"] <= last["left"] + INDENT and near:
                out.append(number)
                last = {**last, **{k: x[k] for k in ("page", "y", "x1", "right", "closed")}, "left": min(last["left"], x["x0"]), "size": last["size"] + 1 + x["size"]}
                continue
        given += 1
        number, last = given, {**x, "left": x["x0"]}
        out.append(number)
    return out


def rebuilt(docs: DataFrame, lines: str, name: str = "paragraphs") -> DataFrame:
    """Adds ``name``: the paragraphs of each document in order; lines in tables bear the label of tables.

    A line goes on with the one before where that reaches the right edge (or the first word would not have fitted), it is not indented,
    no list item, no caption and no numbered heading, and not further below than 1.45 times the usual gap; also over the end of a page. Short
    lines at the head or foot of a page and page numbers stand by themselves after the paragraph they interrupt. A null array stays null."""
    coded = with_edges(docs, lines).withColumn("numbers_", _folded(_flags(F.col(lines)), fold_paragraphs, "array<int>"))
    text = lambda r: F.when(F.coalesce(r["in_table"], F.lit(False)), ln.labelled(ln.TABLE, r["text"])).otherwise(r["text"])
    placed = F.array_sort(F.transform(F.col(lines), lambda r, i: F.struct(F.get(F.col("numbers_"), i).alias("number"), i.alias("i"), text(r).alias("text"))))
    told = coded.withColumn("placed_", placed)
    before = lambda i: F.get(F.col("placed_"), i - 1)["number"]
    glued = F.transform("placed_", lambda p, i: F.concat(F.when((i > 0) & (before(i) == p["number"]), " ").otherwise("\n"), p["text"]))
    return told.withColumn(name, F.filter(F.split(F.array_join(glued, ""), "\n"), lambda t: t != "")).drop("gap", "edges", "numbers_", "placed_")
