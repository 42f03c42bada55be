"""Changes that run through several tables and through arrays inside rows: deleted keys and renamed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_keys(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (with the name of its key column) without the rows of ``gone``; one set of keys for all of them."""
    keys = gone.select(F.col(key).alias("gone_")).distinct()
    return {name: table.join(keys, table[column] == F.col("gone_"), "left_anti") for name, (table, column) in tables.items()}


def _unnested(rows: DataFrame, id_: str, array: str) -> DataFrame:
    return rows.select(id_, F.posexplode(array).alias("pos_", "item_"))


def _nested(items: DataFrame, id_: str, array: str) -> DataFrame:
    put = F.transform(F.array_sort(F.collect_list(F.struct("pos_", "item_"))), lambda x: x["item_"])
    return items.groupBy(id_).agg(put.alias(array))


def rename_nested(rows: DataFrame, id_: str, array: str, names: DataFrame, old: str, new: str) -> DataFrame:
    """``rows`` with the elements of ``array`` that ``names`` renames under their new names, in their order; empty and null arrays stay.

    Only rows with an element to rename are taken apart and put together again, so what is shuffled grows with the changes. Their
    arrays are as long as before; ``id_`` tells rows apart."""
    table = names.select(F.col(old).alias("item_"), F.col(new).alias("new_")).dropDuplicates(["item_"])
    items = _unnested(rows, id_, array)
    touched = items.join(table, "item_", "left_semi").select(id_).distinct()
    changed = items.join(touched, id_, "left_semi").join(table, "item_", "left").select(id_, "pos_", F.coalesce("new_", "item_").alias("item_"))
    put = _nested(changed, id_, "put_")
    return rows.join(put, id_, "left").withColumn(array, F.coalesce("put_", array)).select(*rows.columns)


def without_nested(rows: DataFrame, id_: str, array: str, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without the elements of ``array`` that are keys of ``gone``; an array that loses all of them is empty."""
    keys = gone.select(F.col(key).alias("item_")).distinct()
    items = _unnested(rows, id_, array)
    touched = items.join(keys, "item_", "left_semi").select(id_).distinct()
    left = _nested(items.join(touched, id_, "left_semi").join(keys, "item_", "left_anti"), id_, "put_")
    marked = rows.join(touched.withColumn("touched_", F.lit(True)), id_, "left").join(left, id_, "left")
    return marked.withColumn(array, F.when(F.col("touched_"), F.coalesce("put_", F.slice(array, 1, 0))).otherwise(F.col(array))).select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate that tasks form over their own rows first, so a key with many rows makes no large group."""
    row = F.struct(*order, *[c for c in columns if c not in order])
    return rows.groupBy(*keys).agg(F.max(row).alias("row_")).select(*keys, *[F.col(f"row_.{c}").alias(c) for c in columns])


def next_codes(wanted: DataFrame, taken: DataFrame, code: str, prefix: str, width: int) -> DataFrame:
    """``wanted`` (column n from 1) with the next free codes: numbers after the largest taken one, taken codes in between skipped.

    A taken code may hold a number in a form that the largest number does not show, so candidates are checked against all codes."""
    last = taken.select(F.max(F.regexp_extract(code, f"^{prefix}([0-9]+)$", 1).try_cast("long")).alias("last_"))
    n = wanted.count() + taken.count()
    spare = wanted.sparkSession.range(1, n + 1).join(F.broadcast(last)).select(F.concat(F.lit(prefix), F.lpad((F.coalesce("last_", F.lit(0)) + F.col("id")).cast("string"), width, "0")).alias("code"), F.col("id").alias("at_"))
    free = spare.join(taken.select(F.col(code).alias("code")), "code", "left_anti")
    placed = free.select("code", F.row_number().over(Window.orderBy("at_")).alias("n"))
    return wanted.join(placed, "n")
