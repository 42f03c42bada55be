"""Language identification of mixed texts.

A model holds, for each language, probabilities of hashed 3-grams of bytes (A-Z in lower case, all other ASCII but a-z a
blank). A text is a mixture: expectation maximisation finds the proportions of a set of languages. The set starts with
the likeliest language and grows by the one that gains most, as long as the gain in log likelihood, divided by the
three n-grams that each byte takes part in, exceeds ``PENALTY`` times the logarithm of the number of n-grams.

The model is fitted on about ``PER_LABEL`` documents of each label (a documented bound); the n-gram counts that reach
the driver are at most BINS for each label.

Defined results: null text, empty text and text without letters get ``und`` with score 0. With nothing to learn from,
every text gets ``und``. Texts of any length are read whole. Equal likelihoods go to the label that comes first in order. Repeated rows get equal results;
an empty table gives an empty table; columns named in ``keep`` are carried along whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import CHUNK

BINS = 1 << 16
PER_LABEL = 2000
SMOOTHING = 0.5
PENALTY = 2.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: bytes) -> np.ndarray:
    """Counts of the hashed 3-grams of a text."""
    out = np.zeros(BINS, np.int64)
    for at in range(0, len(data), CHUNK):
        b = _FOLD[np.frombuffer(b" " * (at == 0) + data[max(0, at - 2) : at + CHUNK] + b" ", np.uint8)].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[code != 0x202020] * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(16), minlength=BINS)
    return out


def _has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L is in a text; signs as ½ or Ⅳ are none."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


class Model:
    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = labels
        self.p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS) if len(labels) else counts

    def mixture(self, counts: np.ndarray) -> dict[str, float]:
        """Proportions of the languages of a text, from its 3-gram counts."""
        at = np.flatnonzero(counts)
        if not len(at) or not self.labels:
            return {}
        c, p = counts[at].astype(float), self.p[:, at]
        n = c.sum()
        own = np.log(p) @ c
        chosen, weights = [int(np.argmax(own))], np.ones(1)
        score = own[chosen[0]]
        while len(chosen) < len(self.labels):
            rest = [i for i in range(len(self.labels)) if i not in chosen]
            f, g = weights @ p[chosen], p[rest]
            v = np.full((len(rest), 1), 0.2)
            for _ in range(8):
                both = (1 - v) * f + v * g
                v = (v * ((g / both) @ c)[:, None]) / n
            gain = np.log((1 - v) * f + v * g) @ c - score
            best = int(np.argmax(gain))
            if gain[best] / 3 <= PENALTY * np.log(n + 1):
                break
            chosen.append(rest[best])
            weights = np.append(weights * (1 - v[best, 0]), v[best, 0])
            for _ in range(20):
                q = weights[:, None] * p[chosen]
                weights = (q / q.sum(axis=0)) @ c / n
            score = np.log(weights @ p[chosen]) @ c
        return {self.labels[i]: float(w) for i, w in zip(chosen, weights, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        if not text or not _has_letter(text):
            return UNKNOWN, 0.0, {}
        found = self.mixture(_grams(text.encode()))
        if not found:
            return UNKNOWN, 0.0, {}
        best = max(sorted(found), key=found.__getitem__)
        return best, min(1.0, found[best]), found


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = PER_LABEL) -> Model:
    """A model from the rows with a label and a text."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(text).cast("string")).alias("h")).where("text IS NOT NULL AND label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_label / n))]) if sizes else None
    if share is None:
        return Model([], np.zeros((0, BINS)))
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("label")] * (1 << 20))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for t, k in zip(part.column("text").cast(pa.binary()), part.column("label").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + _grams(t.as_py())
        for k, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["label", "bin", "n"])

    found = sample.select("text", "label").mapInArrow(count, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(found["label"].unique())
    counts = np.zeros((len(labels), BINS))
    counts[found["label"].map({k: i for i, k in enumerate(labels)}).to_numpy(int), found["bin"].to_numpy(int)] = found["n"].to_numpy(float)
    return Model(labels, counts)


def identify(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``; lang_pred, score (its proportion), mixture (map of language to proportion)."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    schema = T.StructType(plain.schema.fields[:-1] + T.StructType.fromDDL("lang_pred string, score double, mixture map<string,double>").fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in parts:
            lang, score, mixture = zip(*(own.predict(t.as_py()) for t in part.column("text_")), strict=True) if part.num_rows else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(m.items()) for m in mixture], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
