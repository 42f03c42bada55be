"""Passages, patchworks and what is left: islands over matched sentences, greedy choice, interval cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same_or_empty(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == "") | (b == "") | (a == b)


def passage_islands(matches: DataFrame) -> DataFrame:
    """Runs of two or more matches of one source in which both sides go on by one sentence within a paragraph.

    Order is target then source sentence; a run goes on only from the row just before. Windows are within one
    submission and one source, so none grows with the number of documents."""
    order = Window.partitionBy("doc_id", "source_doc").orderBy("idx", "source_idx")
    back = lambda c: F.lag(c).over(order)
    goes_on = (F.col("idx") == back("idx") + 1) & (F.col("source_idx") == back("source_idx") + 1) & _same_or_empty(F.col("paragraph_id"), back("paragraph_id")) & _same_or_empty(F.col("source_paragraph_id"), back("source_paragraph_id"))
    rows = matches.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    runs = rows.groupBy("doc_id", "source_doc", "island").agg(
        F.min("idx").alias("t_from"), F.max("idx").alias("t_to"), F.min("source_idx").alias("s_from"), F.max("source_idx").alias("s_to"),
        F.count("*").alias("n"), F.avg("similarity").alias("sim_avg"), F.max("similarity").alias("sim_max"),
    )
    return runs.where("n >= 2").drop("island")


def _places(index: DataFrame) -> DataFrame:
    return index.where("is_sample").select(F.col("doc_id").alias("source_doc"), F.col("idx").alias("source_idx"), F.col("paragraph_id").alias("source_paragraph_id"), "sentence_hash")


def exact_places(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Source sentences that ``rows`` match exactly: what stands before each, and the first and last place of its text in the source."""
    in_source = _places(index).join(rows.where("is_exact").select("sentence_hash").distinct(), "sentence_hash", "left_semi")
    in_order, of_text = Window.partitionBy("source_doc").orderBy("source_idx"), Window.partitionBy("source_doc", "sentence_hash")
    place = in_source.select("*", *[F.lag(c).over(in_order).alias(f"{c}_0") for c in ("source_idx", "source_paragraph_id", "sentence_hash")])
    place = place.select("*", F.min("source_idx").over(of_text).alias("first"), F.max("source_idx").over(of_text).alias("last"))
    # the sentence before is the last of its text: the place of the next sentence knows it by the row before
    return place.withColumn("last_0", F.lag("last").over(in_order))


def passage_islands_of_copies(rows: DataFrame, near: DataFrame, index: DataFrame, place: DataFrame | None = None) -> DataFrame:
    """``passage_islands`` of all matches, without making the exact ones: of ``rows`` (``matching.matched``) and the ``near`` matches.

    A row goes on from the row just before only if that is the last match of its sentence in the source and itself the first of
    its own. Which these are of an exact match follows from the source alone, so pairs of neighbouring sentences are joined by both their hashes, and
    a sentence that very many documents hold makes no row unless the one beside it is shared too. ``place`` are the
    ``exact_places`` of ``rows``, or of more rows, if they are at hand."""
    sample = _places(index)
    place = exact_places(rows, index) if place is None else place
    before = F.col("source_idx_0") == F.col("source_idx") - 1
    couples = place.where(before & (F.col("first") == F.col("source_idx")) & (F.col("last_0") == F.col("source_idx_0")) & _same_or_empty(F.col("source_paragraph_id"), F.col("source_paragraph_id_0")))
    couples = couples.select("source_doc", "source_idx", F.col("sentence_hash_0").alias("hash_0"), F.col("sentence_hash").alias("hash"))

    back = rows.select("doc_id", (F.col("idx") + 1).alias("idx"), F.col("paragraph_id").alias("paragraph_0"), F.col("sentence_hash").alias("hash_0"), F.col("is_exact").alias("exact_0"))
    steps = rows.withColumnRenamed("sentence_hash", "hash").join(back, ["doc_id", "idx"]).where(_same_or_empty(F.col("paragraph_id"), F.col("paragraph_0"))).select("doc_id", "idx", "hash", "hash_0", "is_exact", "exact_0")
    link = lambda df, sim_0, sim: df.select("doc_id", "source_doc", "idx", "source_idx", F.lit(sim_0).alias("sim_0") if isinstance(sim_0, float) else F.col(sim_0).alias("sim_0"), F.lit(sim).alias("sim") if isinstance(sim, float) else F.col(sim).alias("sim"))
    both = link(steps.where("is_exact AND exact_0").join(couples, ["hash_0", "hash"]).where("doc_id <> source_doc"), 1.0, 1.0)

    told = near.select("doc_id", "idx", "source_doc", "source_idx", "similarity").join(sample.drop("sentence_hash"), ["source_doc", "source_idx"])
    at = F.struct("source_idx", "similarity", "source_paragraph_id")
    ends = told.groupBy("doc_id", "idx", "source_doc").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    # what comes next after a near match, at the place behind its last; and what comes before one, at the place before its first
    after = ends.select("doc_id", (F.col("idx") + 1).alias("idx"), "source_doc", (F.col("hi.source_idx") + 1).alias("source_idx"), F.col("hi.similarity").alias("sim_0"), F.col("hi.source_paragraph_id").alias("near_paragraph"))
    ahead = ends.select("doc_id", "idx", "source_doc", (F.col("lo.source_idx") - 1).alias("at"), F.col("lo.source_idx").alias("source_idx"), F.col("lo.similarity").alias("sim"), F.col("lo.source_paragraph_id").alias("near_paragraph"))
    within = _same_or_empty(F.col("source_paragraph_id"), F.col("near_paragraph"))
    firsts = place.where("first = source_idx").select("source_doc", "source_idx", "source_paragraph_id", F.col("sentence_hash").alias("hash"))
    lasts = place.where("last = source_idx").select("source_doc", F.col("source_idx").alias("at"), "source_paragraph_id", F.col("sentence_hash").alias("hash_0"))
    to_exact = link(steps.where("is_exact AND NOT exact_0").join(after, ["doc_id", "idx"]).join(firsts, ["source_doc", "source_idx", "hash"]).where(within), "sim_0", 1.0)
    to_near = link(steps.where("NOT is_exact AND exact_0").join(ahead, ["doc_id", "idx"]).join(lasts, ["source_doc", "at", "hash_0"]).where(within), 1.0, "sim")
    nears = link(steps.where("NOT is_exact AND NOT exact_0").join(after, ["doc_id", "idx"]).join(ahead.withColumnRenamed("near_paragraph", "source_paragraph_id"), ["doc_id", "idx", "source_doc", "source_idx"]).where(within), "sim_0", "sim")
    links = both.unionByName(to_exact).unionByName(to_near).unionByName(nears)

    order = Window.partitionBy("doc_id", "source_doc").orderBy("idx")
    goes_on = (F.col("idx") == F.lag("idx").over(order) + 1) & (F.col("source_idx") == F.lag("source_idx").over(order) + 1)
    runs = links.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    whole = runs.groupBy("doc_id", "source_doc", "island").agg(
        (F.min("idx") - 1).alias("t_from"), F.max("idx").alias("t_to"), (F.min("source_idx") - 1).alias("s_from"), F.max("source_idx").alias("s_to"),
        (F.count("*") + 1).alias("n"), F.sum("sim").alias("sim_sum"), F.max("sim").alias("sim_max"), F.min_by("sim_0", "idx").alias("sim_first"))
    return whole.select("doc_id", "source_doc", "t_from", "t_to", "s_from", "s_to", "n", ((F.col("sim_first") + F.col("sim_sum")) / F.col("n")).alias("sim_avg"), F.greatest("sim_first", "sim_max").alias("sim_max"))


def greedy(spans: DataFrame, keys: list[str], priority: list[Column], fields: list[str], a: str = "t_from", b: str = "t_to") -> DataFrame:
    """Of the spans under ``keys`` in order of ``priority``, those that overlap none taken before. Arrays hold the spans
    of one submission (and source)."""
    row = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], *[F.col(f) for f in fields])
    ordered = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y[a] <= x[b]) & (x[a] <= y[b])), acc).otherwise(F.array_append(acc, x)))
    out = ordered.select(*keys, F.explode(taken).alias("x"))
    return out.select(*keys, *[F.col(f"x.{f}").alias(f) for f in fields])


PASSAGE = ["t_from", "t_to", "s_from", "s_to", "n", "sim_avg", "sim_max"]


def passages(matches: DataFrame) -> DataFrame:
    """Passages of all these matches."""
    return best_islands(passage_islands(matches))


def best_islands(islands: DataFrame) -> DataFrame:
    """Islands of each source that do not overlap: the longest first, then the more similar, then the earlier."""
    return greedy(islands, ["doc_id", "source_doc"], [-F.col("n"), -F.col("sim_avg"), F.col("t_from")], PASSAGE)


def document_passages(found: DataFrame) -> DataFrame:
    """doc_id, n_passages: passages of all sources that overlap none longer."""
    # equal spans shut each other out, so one of each is enough: no array grows with the number of sources
    spans = found.groupBy("doc_id", "t_from", "t_to").agg(F.max("n").alias("n"), F.min("source_doc").alias("source_doc"))
    taken = greedy(spans, ["doc_id"], [-F.col("n"), F.col("t_from"), F.col("source_doc")], ["t_from", "t_to", "n"])
    return taken.groupBy("doc_id").agg(F.count("*").alias("n_passages"))


def covered(spans: DataFrame) -> DataFrame:
    """doc_id, idx of every sentence inside a span."""
    return spans.select("doc_id", F.explode(F.sequence("t_from", "t_to")).alias("idx")).distinct()


def patchwork_runs(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """``rows`` (a matched sentence each) outside passages that stand in a run of two or more within a paragraph, with the run's ``island``."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    goes_on = (F.col("idx") == F.lag("idx").over(order) + 1) & _same_or_empty(F.col("paragraph_id"), F.lag("paragraph_id").over(order))
    left = rows.join(inside, ["doc_id", "idx"], "left_anti")
    runs = left.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order)).drop("fresh")
    return runs.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "island"))).where("n >= 2").drop("n")


def patchwork_islands(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of matched sentences outside passages, put together from several places; ``matches`` need hold no others.

    A run is a patchwork if it has two or more sources, or one whose sorted sentence numbers are not
    strictly consecutive (repeated ones included)."""
    by_source = matches.select("doc_id", "idx", "source_doc", "source_idx").join(runs.select("doc_id", "idx", "island"), ["doc_id", "idx"])
    gap = F.col("source_idx") - F.lag("source_idx").over(Window.partitionBy("doc_id", "island", "source_doc").orderBy("source_idx"))
    parts = by_source.withColumn("gap", gap).groupBy("doc_id", "island", "source_doc").agg(
        F.min("source_idx").alias("s_from"), F.max("source_idx").alias("s_to"), F.count("*").alias("n_rows"), F.max(F.coalesce(F.col("gap") != 1, F.lit(False))).alias("broken"))
    whole = runs.groupBy("doc_id", "island").agg(F.min("idx").alias("t_from"), F.max("idx").alias("t_to"), F.count("*").alias("n"))
    detail = parts.groupBy("doc_id", "island").agg(F.count("*").alias("n_sources"), F.max("broken").alias("broken"), F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.struct("source_doc", "s_from", "s_to", F.col("n_rows").alias("n")))).alias("detail"))
    return whole.join(detail, ["doc_id", "island"]).where("n_sources >= 2 OR broken").select("doc_id", "t_from", "t_to", "n", "n_sources", "n_rows", "detail")


def patchworks(matches: DataFrame, inside: DataFrame) -> DataFrame:
    """Patchworks of all these matches."""
    rows = matches.groupBy("doc_id", "idx").agg(F.min("paragraph_id").alias("paragraph_id"))
    return best_patchworks(patchwork_islands(matches, patchwork_runs(rows, inside)))


def best_patchworks(islands: DataFrame) -> DataFrame:
    """Patchworks that do not overlap: longest first, then more sources, then more rows."""
    return greedy(islands, ["doc_id"], [-F.col("n"), -F.col("n_sources"), -F.col("n_rows"), F.col("t_from")], ["t_from", "t_to", "n", "n_sources", "detail"])


def remainder(matches: DataFrame, found: DataFrame, patched: DataFrame) -> DataFrame:
    """doc_id, idx of matched sentences in no passage and no patchwork."""
    inside = covered(found).union(covered(patched)).distinct()
    return matches.select("doc_id", "idx").distinct().join(inside, ["doc_id", "idx"], "left_anti")


def match_kinds(matches: DataFrame, found: DataFrame, patched: DataFrame) -> DataFrame:
    """doc_id, idx, kind of every matched sentence: passage, else patchwork, else sentence."""
    a, b = covered(found).withColumn("in_passage", F.lit(True)), covered(patched).withColumn("in_patchwork", F.lit(True))
    rows = matches.select("doc_id", "idx").distinct().join(a, ["doc_id", "idx"], "left").join(b, ["doc_id", "idx"], "left")
    return rows.select("doc_id", "idx", F.when(F.col("in_passage"), "passage").when(F.col("in_patchwork"), "patchwork").otherwise("sentence").alias("kind"))
