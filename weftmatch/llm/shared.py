"""Where intermediate tables go, and connected components over links."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests), a folder of our own; on a cluster this is an error,
    as executors do not see each other's temporary folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and known.isDefined():
        return known.get()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-", dir=os.environ.get("TMPDIR"))
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """While a table is written, its shuffle files go as soon as it stands."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


class Scratch:
    """The tables that one call of an operator writes to the shared folder.

    ``put`` writes a table and reads it again, a cut in the lineage that outlives executors; ``drop`` deletes tables that
    nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        with _shuffles_cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for known, path in self.paths:
                if known is table:
                    where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Scratch(df.sparkSession).put(df, name)


#: keys of rows that no doc_id tells apart lie above every doc_id, those without a doc_id above these
_OWN, _NO_ID = 1 << 62, 1 << 61
#: that many repeated ids are sent to every task; more are met in a shuffle
SENT_IDS = 200_000


def row_keys(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with row_key (long) and is_told_apart (boolean), and whether any row is not told apart by its doc_id.

    The key of a row is its doc_id where no other row has it. Rows that share a doc_id, and rows without one, get keys by a 61-bit hash
    of id and text, so that rows of one id with different texts are apart, and rows that repeat id and text have one key. It depends on
    content alone, and so is the same each time ``docs`` is read. Smaller ids have smaller keys; a doc_id of 2**62 or more counts as shared."""
    own = F.col(doc_id).cast("long")
    ids = docs.select(own.alias("shared_id"))
    counts = ids.groupBy("shared_id").agg(F.count("*").alias("n_rows")).where(f"n_rows > 1 OR shared_id IS NULL OR shared_id >= {_OWN}")
    shared = scratch.put(counts.select("shared_id"), "shared_ids")
    n = shared.count()
    if not n:
        return docs.withColumns({"row_key": own, "is_told_apart": F.lit(True)}), False
    table = shared.where("shared_id IS NOT NULL").withColumn("is_shared", F.lit(True))
    joined = docs.join(F.broadcast(table) if n <= SENT_IDS else table, own == F.col("shared_id"), "left")
    hashed = F.xxhash64(own, F.col(text).cast("string")).bitwiseAND(_NO_ID - 1)
    key = F.when(own.isNull(), hashed + (_OWN + _NO_ID)).when(F.col("is_shared"), hashed + _OWN).otherwise(own)
    return joined.withColumns({"row_key": key, "is_told_apart": key < _OWN}).drop("shared_id", "is_shared"), True


def each_once(keyed: DataFrame, some_shared: bool) -> DataFrame:
    """One row of each row_key; only rows that their doc_id does not tell apart are shuffled for it."""
    return keyed.where("is_told_apart").unionByName(keyed.where("NOT is_told_apart").dropDuplicates(["row_key"])) if some_shared else keyed


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Each round takes the label of a node's label, sends it over the links, and hooks both the node and its label to the
    smallest that arrives, so that trees merge at their roots; chains take a logarithmic number of rounds. Every round
    is written to the shared folder and the one before it deleted. Empty links give an empty table.
    """
    both = scratch.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(max_rounds):
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        grand = labels.select("node", "component").join(up, "component")
        near = both.join(grand.select(F.col("node").alias("b"), "higher"), "b").groupBy(F.col("a").alias("node")).agg(F.min("higher").alias("near"))
        seen = grand.join(near, "node")
        own = seen.select("node", F.least("higher", "near").alias("component"), F.col("component").alias("before"))
        hooked = seen.select(F.col("component").alias("node"), F.col("near").alias("component"), F.lit(None).cast("long").alias("before"))
        new = scratch.put(own.union(hooked).groupBy("node").agg(F.min("component").alias("component"), F.max("before").alias("before")), "labels")
        scratch.drop(labels)
        labels = new
        if not labels.where("component <> before").limit(1).count():
            scratch.drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
