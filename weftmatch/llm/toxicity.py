"""Toxic passages by maximum-scoring segments.

*Scores of words.* Log odds of meeting a word in toxic against other texts, with an informative Dirichlet prior: a word
counts once a text, and its prior count is its share of all texts times ``PRIOR``. Beginnings of longer words (``BEGINS`` bytes) are scored
alike, so that a root is known in compounds never seen. Only those whose log odds are ``MIN_Z`` standard deviations from
0 keep them, at most ``VOCABULARY`` of them. A word has its own score, else that of its longest beginning, else 0, less
a constant ``DRIFT``.

*Segments.* The linear scan of Ruzzo and Tompa finds all maximal scoring segments of a text.

*Extreme values.* With lambda from the distribution of word scores in texts that are not toxic, the best score S of n
words has P(S >= x) = 1 - exp(-K n exp(-lambda x)); K is fitted on the same texts. A segment is significant where its
E-value K n exp(-lambda x) is below ``E_VALUE``. A text is scored by a logistic curve of the logarithms of the best
normalised score, of the sum over its significant segments and of n, fitted on the labelled texts.

Words and curve are fitted on at most about ``PER_LABEL`` texts of each label (a documented bound).

Defined results: null or empty texts score as texts without any segment do. Texts of any length are scanned whole. Without
labels, or with one kind only, every text scores 0. Of repeated labels of one document the largest counts, once. Ties in
score and ties of words at the ``VOCABULARY`` bound go by the word's hash. Repeated rows get equal scores; an empty table gives an empty table; columns named in ``keep`` are
carried along whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .shared import stored

PER_LABEL = 5_000
PRIOR = 10.0
MIN_Z = 2.5
BEGINS = (6, 5, 4)
VOCABULARY = 50_000
DRIFT = 0.3
E_VALUE = 0.05


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal scoring segments, in order (Ruzzo and Tompa's scan).

    Each open segment keeps the place of the nearest one before it with a smaller sum in front, so a search follows these
    links and never walks over the segments between them; a link is followed once before what it skips is merged or shut off."""
    open_: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, nearest with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, j = i, before, len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] >= left:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= total:
                open_.append((first, i + 1, left, total, j))
                break
            first, left, back = open_[j][0], open_[j][2], open_[j][4]
            del open_[j:]
            j = back
    return [(a, b, r - lo) for a, b, lo, r, _ in open_]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The same over many words: runs of one sign are taken together, as no maximal segment ends inside one."""
    if not len(scores) or not (scores > 0).any():
        return []
    sign = scores > 0
    edge = np.concatenate(([0], np.flatnonzero(sign[1:] != sign[:-1]) + 1))
    ends = np.append(edge[1:], len(scores))
    return [(int(edge[a]), int(ends[b - 1]), s) for a, b, s in maximal_segments(np.add.reduceat(scores, edge).tolist())]


@dataclass
class Model:
    """Word hashes in order with their scores; lambda, log K; intercept and weights of the curve (None: scores are 0)."""

    words: np.ndarray
    scores: np.ndarray
    scale: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, ...] | None = None

    def word_scores(self, text: bytes) -> np.ndarray:
        h, begins = textnum.hash_prefixes(text, BEGINS, textnum.APART)
        if not len(self.words):
            return np.full(len(h), -DRIFT)
        out = np.zeros(len(h))
        for found in (*(begins[k] for k in reversed(BEGINS)), h):
            at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            out = np.where(self.words[at] == found, self.scores[at], out)
        return out - DRIFT

    def features(self, text: bytes) -> tuple[float, float, float, list[tuple[int, int, float]]]:
        """Best normalised score, sum of the significant ones, log of words, significant segments (first, end, E-value)."""
        scores = self.word_scores(text)
        n = math.log(len(scores) + 1)
        best, total, found = 0.0, 0.0, []
        for a, b, s in segments(scores):
            normal = self.scale * s
            best = max(best, normal)
            if (log_e := self.log_k + n - normal) < math.log(E_VALUE):
                total -= log_e
                found.append((a, b, math.exp(max(-700.0, log_e))))
        return best, total, n, found

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        best, total, n, found = self.features(text)
        if self.curve is None:
            return 0.0, found
        x = self.curve[0] + self.curve[1] * math.log1p(best) + self.curve[2] * math.log1p(total) + self.curve[3] * n
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x)))), found


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve with a small ridge, by Newton's method; features are scaled while fitting."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = np.column_stack((np.ones(len(x)), x / scale))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-2] * len(scale))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in np.append(w[0], w[1:] / scale))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model from the texts of ``docs`` that ``labels`` marks 0 or 1.

    Which labelled documents are taken is decided on the labels alone; their ids, about 2 * per_label rows, are
    broadcast, so that no other text moves."""
    marks = labels.select(F.col(doc_id).alias("id_"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND id_ IS NOT NULL").groupBy("id_").agg(F.max("y").alias("y"))
    marks = marks.join(docs.select(F.col(doc_id).alias("id_")).distinct(), "id_", "left_semi")
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    share = F.when(F.col("y") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))
    chosen = marks.where(F.pmod(F.xxhash64("id_", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    plain = docs.select(F.col(doc_id).alias("id_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = stored(plain.join(F.broadcast(chosen), "id_").select("text", "y"), "labelled")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            y = part.column("y").to_numpy()
            texts = part.column("text").cast(pa.binary())
            for k in (0, 1):
                own = [textnum.hash_prefixes(texts[int(i)].as_py(), BEGINS, textnum.APART) for i in np.flatnonzero(y == k)]
                own = [np.unique(x[x != 0]) for h, begins in own for x in (h, *begins.values())]
                words, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                zero = np.zeros_like(n)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n if k == 0 else zero), pa.array(n if k else zero)], names=["word", "n0", "n1"])

    counts = sample.mapInArrow(count, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = float(total.get(0, 0)), float(total.get(1, 0))
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    prior = (F.col("n0") + F.col("n1")) / (n0 + n1) * PRIOR
    odds = lambda c, n: F.log((F.col(c) + prior) / (n + PRIOR - F.col(c) - prior + 0.5))
    delta = odds("n1", n1) - odds("n0", n0)
    z = delta / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    kept = counts.select("word", delta.alias("score"), z.alias("z")).where(F.abs("z") >= MIN_Z)
    chosen = kept.orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).toPandas()
    words = chosen["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], chosen["score"].to_numpy(float)[order])

    # lambda: the positive root of sum p exp(lambda s) = 1 over the scores of words in texts that are not toxic
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def histogram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            calm = part.filter(pa.array(part.column("y").to_numpy() == 0))
            scores = [sent.value.word_scores(t.as_py()) for t in calm.column("text").cast(pa.binary())]
            value, n = np.unique(np.round(np.concatenate(scores), 1), return_counts=True) if scores else (np.zeros(0), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["value", "n"])

    seen = sample.mapInArrow(histogram, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).toPandas()
    values, share_of = seen["value"].to_numpy(float), seen["n"].to_numpy(float) / max(1.0, seen["n"].sum())
    low, high = 1e-6, 1.0
    root = lambda x: float(share_of @ np.exp(np.minimum(x * values, 700)) - 1)
    while root(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if root(mid) < 0 else (low, mid)
    model.scale = high
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [sent.value.features(t.as_py()) for t in part.column("text").cast(pa.binary())]
            segs = [[-math.log(max(e, 1e-300)) for _, _, e in f[3]] for f in found]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([sum(s) for s in segs], pa.float64())], names=["y", "best", "n", "total"])

    # at most about 2 * per_label rows of four numbers
    seen = sample.mapInArrow(features, "y int, best double, n double, total double").toPandas()
    calm = seen[seen["y"] == 0]
    model.log_k = float((calm["best"] - calm["n"]).mean() - 0.5772156649) if len(calm) else 0.0
    sent = docs.sparkSession.sparkContext.broadcast(model)
    again = lambda parts: features(parts)
    seen = sample.mapInArrow(again, "y int, best double, n double, total double").toPandas()
    x = np.column_stack((np.log1p(seen["best"]), np.log1p(np.maximum(seen["total"], 0.0)), seen["n"]))
    model.curve = _logistic(x, seen["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text", spans: bool = False) -> DataFrame:
    """Columns ``keep`` and score; with ``spans`` also the significant passages (first word, end word, E-value)."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    added = "score double" + ", passages array<struct<first:long,end:long,e_value:double>>" * spans
    schema = T.StructType(plain.schema.fields[:-1] + T.StructType.fromDDL(added).fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [sent.value.score(t.as_py() or b"") for t in part.column("text_").cast(pa.binary())]
            columns = [pa.array([f[0] for f in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))
                columns.append(pa.array([[{"first": a, "end": b, "e_value": e} for a, b, e in f[1]] for f in found], kind))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
