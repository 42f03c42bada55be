"""Boxes on pages: points inside rectangles, boxes that stand on one line, headers and footers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: how far outside a table's border a point still counts, the share of a height within which boxes are on one line,
#: and the share of a page's height at either end that holds headers and footers
TOLERANCE, SAME_LINE, BAND = 2.0, 0.6, 0.05
#: side of the cells in which points and rectangles meet; about the size of a rectangle
CELL = 64.0


def inside(points: DataFrame, rectangles: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``points`` (keys, x, y) that lie in a rectangle (keys, x0, y0, x1, y1) or within ``tolerance`` of it, each once.

    A rectangle goes to every cell of a grid that it touches and a point to its own, so they meet by equality and no point is
    compared with a rectangle elsewhere on its page. Rows of ``points`` are told apart by all their columns."""
    cell = lambda c: F.floor(c / CELL).cast("long")
    wide = rectangles.select(*keys, (F.col("x0") - tolerance).alias("x0"), (F.col("x1") + tolerance).alias("x1"), (F.col("y0") - tolerance).alias("y0"), (F.col("y1") + tolerance).alias("y1")).where("x0 <= x1 AND y0 <= y1").distinct()
    spread = wide.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    met = points.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))}).join(spread, [*keys, "cx", "cy"])
    return met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select(*points.columns).distinct()


def without_bands(boxes: DataFrame, heights: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes whose middle is not in the outer twentieth of their page's height; a page of unknown height keeps all its boxes."""
    middle = F.col("y") + F.col("height") / 2
    told = boxes.join(heights.select(*keys, "page_height"), keys, "left")
    return told.where(F.col("page_height").isNull() | middle.between(BAND * F.col("page_height"), (1 - BAND) * F.col("page_height"))).select(*boxes.columns)


def fold_lines(boxes: list[dict]) -> list[int]:
    """For each box the number of its line. A box joins the first line whose first box is within 0.6 of the box's own height, or else begins one."""
    starts, out = [], []
    for b in boxes:
        near = SAME_LINE * max(b["height"], 1.0)
        at = next((k for k, y in enumerate(starts) if abs(y - b["y"]) <= near), len(starts))
        if at == len(starts):
            starts.append(b["y"])
        out.append(at)
    return out


def _line_numbers(rows: pa.Array) -> pa.Array:
    # a page at a time: the boxes of a whole batch as Python objects take gigabytes
    return pa.array((None if not r.is_valid else fold_lines(r.as_py()) for r in rows), pa.list_(pa.int32()), size=len(rows))


def lines_of_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, y, x_from, x_to, height, n: the lines of each page, made of its boxes (x, y, width, height) in order of ``place``.

    The boxes of one page come together; boxes without width are left out."""
    number = F.arrow_udf(_line_numbers, T.ArrayType(T.IntegerType()))
    pages = boxes.where("width > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "width", "height"))).alias("boxes"))
    told = pages.withColumn("lines", number(F.transform("boxes", lambda b: F.struct(b["y"].alias("y"), b["height"].alias("height"))))).select(*keys, F.explode(F.arrays_zip("boxes", "lines")).alias("b"))
    row = told.select(*keys, F.col("b.lines").alias("line"), "b.boxes.*")
    return row.groupBy(*keys, "line").agg(
        F.min_by("y", "place").alias("y"), F.min("x").alias("x_from"), F.max(F.col("x") + F.col("width")).alias("x_to"), F.max("height").alias("height"), F.count("*").alias("n"),
    )
