"""Benchmark decontamination: BM25 retrieval of test items by training passages with block-max WAND, then verification.

The test items are cut into units of at most ``UNIT`` words, and an inverted index over the units keeps for each term
its postings in blocks with the largest weight of a block, and the largest weights in coarse and fine ranges of
units. Weights are BM25 weights divided by the score that a unit
gives itself, so that one threshold holds for units of all lengths. Every document is cut into passages of two
neighbouring steps of ``STEP`` words; every passage is a query and gets all units at or above the threshold. A passage
that cannot reach it in any range, coarse or fine, even at its words' largest weights there, has no unit to find and
ends there; the others go through WAND with block maxima.

A document and an item are reported if the document holds at least ``share`` of the 5-word shingles of the item's
question (of the whole item, where its question is shorter) and the matched passages hold at least ``share`` of the words of its answer. The answer is the last sentence
of an item, or its last third where it is one sentence.

Words are compared without case (A-Z) and ASCII punctuation.

Defined results: null or empty documents and items without words match nothing. Texts of any length are searched whole.
Rows of one item_id with different texts are items of their own, reported under that id once, by the text that is held
best (of ties the first by text). Repeated rows are reported each for
itself; an item that a document holds twice is reported once. Empty tables give an empty table. The index of at most
``BLOCK_BYTES`` of item text is sent to the executors at a time; larger benchmarks are processed in blocks of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .shared import Scratch, row_keys

UNIT = 48
STEP = 32
BLOCK = 16
#: ranges of units at the coarse and the fine level, and the most bytes of the fine one
RANGES, FINE, FINE_BYTES = 64, 512, 64 << 20
BLOCK_BYTES = 4 << 20
K1, B = 1.2, 0.75
#: words of a shingle; all words of a shorter item
GRAM = 5
_END = re.compile(r"(?<=[.!?])\s+(?=\S)")


def _words(text: str | bytes) -> np.ndarray:
    return textnum.hash_words(text.encode() if isinstance(text, str) else text, lower=True, apart=textnum.APART)


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer."""
    *head, last = _END.split(text.strip())
    question, answer = _words(" ".join(head)), _words(last)
    if not len(question) or not len(answer):
        both = _words(text)
        cut = max(1, len(both) - len(both) // 3)
        question, answer = both[:cut], both[cut:] if len(both) > cut else both
    return question, answer


def _grams(words: np.ndarray, k: int = GRAM) -> np.ndarray:
    return np.unique(textnum.shingles(words, k))


@dataclass
class Index:
    """Inverted index of units: term t has units[start[t]:start[t+1]] with weights, and block maxima."""

    terms: np.ndarray
    start: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    top: np.ndarray
    item_of: list[int]
    #: of each row of the items (two may have one item_id): item_id, words of a shingle, shingles of the question, words of the answer
    items: dict[int, tuple[int, int, np.ndarray, np.ndarray]]
    block_top: list[np.ndarray] = field(default_factory=list)
    #: largest weight of each term in each of at most RANGES ranges of units; the last row is for words without a term
    range_top: np.ndarray | None = None
    fine_top: np.ndarray | None = None

    def postings(self, t: int) -> tuple[list[int], list[float], list[float]]:
        a, b = self.start[t], self.start[t + 1]
        return self.units[a:b].tolist(), self.weights[a:b].tolist(), self.block_top[t].tolist()


def build_index(items: list[tuple[int, str]], n_units: int | None = None, df: dict[int, int] | None = None, mean: float | None = None) -> Index:
    """The index of some items. For a benchmark in blocks, ``n_units``, ``df`` (by term hash) and ``mean`` (words a unit) are those of the whole."""
    units, item_of, known = [], [], {}
    for row, (item, text) in enumerate(items):
        words = _words(text or "")
        if not len(words):
            continue
        question, answer = question_and_answer(text)
        k = min(GRAM, len(words))
        # a question of fewer words has no shingle of its own: the whole item stands for it
        known[row] = (item, k, _grams(question if len(question) >= k else words, k), np.unique(answer))
        pieces = max(1, -(-len(words) // UNIT))
        for piece in np.array_split(words, pieces):
            units.append(piece)
            item_of.append(row)
    flat = np.concatenate(units) if units else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units]).astype(np.int64)
    terms, code = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(code * max(1, len(units)) + owner, return_counts=True)
    term, unit = pair // max(1, len(units)), pair % max(1, len(units))
    n = n_units if n_units is not None else len(units)
    own_df = np.bincount(term, minlength=len(terms))
    counts = own_df if df is None else np.array([df[int(t)] for t in terms])
    idf = np.log1p((n - counts + 0.5) / (counts + 0.5))
    size = np.array([len(u) for u in units], float)
    mean = mean if mean is not None else (size.mean() if len(size) else 1.0)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / mean))
    self_score = np.bincount(unit, weight, minlength=len(units))
    weight = weight / np.maximum(self_score[unit], 1e-12)
    start = np.concatenate(([0], np.cumsum(own_df)))
    top = np.maximum.reduceat(weight, start[:-1]) if len(terms) else np.zeros(0)
    index = Index(terms, start, unit, weight, top, item_of, known)
    index.block_top = [np.maximum.reduceat(weight[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(start[:-1], start[1:], strict=True)]
    fine = max(1, min(FINE, len(units), FINE_BYTES // (4 * (len(terms) + 1))))
    index.range_top, index.fine_top = (_range_tops(term, unit, weight, len(terms), len(units), n) for n in (RANGES, fine))
    return index


def _range_tops(term: np.ndarray, unit: np.ndarray, weight: np.ndarray, n_terms: int, n_units: int, ranges: int) -> np.ndarray:
    out = np.zeros((n_terms + 1, ranges), np.float32)
    np.maximum.at(out, (term, unit * ranges // max(1, n_units)), weight)
    return out


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """(unit, score) of every unit whose summed weights over the distinct terms ``query`` reach ``threshold``."""
    cursors = []  # [current unit, place, units, weights, block tops, largest weight]
    for t in query:
        units, weights, tops = index.postings(t)
        cursors.append([units[0], 0, units, weights, tops, float(index.top[t])])
    slack = threshold - 1e-9
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[5]
            if bound >= slack:
                pivot = i
                break
        if pivot < 0:
            break
        unit = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
            pivot += 1
        block_bound, leave = 0.0, None
        for c in cursors[: pivot + 1]:
            units, at = c[2], c[1]
            while (end := min((at // BLOCK + 1) * BLOCK, len(units))) <= len(units) and units[end - 1] < unit:
                if end == len(units):
                    break
                at = end
            if units[end - 1] >= unit:
                block_bound += c[4][at // BLOCK]
                leave = units[end - 1] if leave is None else min(leave, units[end - 1])
        if block_bound >= slack:
            if cursors[0][0] == unit:
                score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    found.append((unit, score))
                to = unit + 1
            else:
                to = unit
        else:
            to = max(unit, leave if leave is not None else unit) + 1
            if pivot + 1 < len(cursors):
                to = max(unit + 1, min(to, cursors[pivot + 1][0])) if cursors[pivot + 1][0] > unit else unit + 1
        for c in cursors[: pivot + 1]:
            units, at = c[2], c[1]
            while at < len(units) and units[at] < to:
                at += 1
            c[1], c[0] = at, units[at] if at < len(units) else -1
        cursors = [c for c in cursors if c[1] < len(c[2])]
    return found


def search(index: Index, text: bytes, threshold: float) -> dict[int, tuple[float, list[int]]]:
    """Items that some passage of a text retrieves: best score, and the passages (by their first step)."""
    words = _words(text)
    if not len(words) or not len(index.terms):
        return {}
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    row = np.where(known, at, len(index.terms))
    reach = []  # the largest sum of range tops of each passage
    for lo in range(0, len(words), 512 * STEP):
        rows = index.range_top[row[lo : lo + 513 * STEP]]
        steps = np.add.reduceat(rows, np.arange(0, len(rows), STEP), axis=0)
        steps[:-1] += steps[1:]
        reach.append(steps.max(axis=1)[:512])
    bound = np.concatenate(reach)
    out: dict[int, tuple[float, list[int]]] = {}
    for p in np.flatnonzero(bound >= threshold - 1e-4).tolist():
        here = slice(p * STEP, (p + 2) * STEP)
        query = np.unique(at[here][known[here]])
        if index.fine_top[query].sum(axis=0).max(initial=0.0) < threshold - 1e-4:
            continue
        for unit, score in block_max_wand(index, query.tolist(), threshold):
            item = index.item_of[unit]
            best, places = out.get(item, (0.0, []))
            out[item] = max(best, score), [*places, p]
    return out


def verify(index: Index, text: bytes, found: dict[int, tuple[float, list[int]]]) -> list[tuple[int, float, float, float, int]]:
    """(item_id, score, question overlap, answer overlap, first word) of retrieved items."""
    if not found:
        return []
    words = _words(text)
    grams: dict[int, np.ndarray] = {}
    out: dict[int, tuple[int, float, float, float, int]] = {}
    for row, (score, places) in sorted(found.items()):
        item, k, question, answer = index.items[row]
        if k not in grams:
            grams[k] = _grams(words, k)
        # the passages and a step on either side, as an item may reach beyond what retrieved it
        near = np.concatenate([words[max(0, (p - 1) * STEP) : (p + 3) * STEP] for p in places])
        hit = (item, score, float(np.isin(question, grams[k]).mean()), float(np.isin(answer, near).mean()), min(places) * STEP)
        # of rows with one item_id the one that is held best
        if item not in out or (min(hit[2:4]), score) > (min(out[item][2:4]), out[item][1]):
            out[item] = hit
    return sorted(out.values())


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, share: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of every verified pair."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    spark = docs.sparkSession
    whole: tuple = (None, None, None)
    if n_blocks > 1:
        whole = _statistics(tests)
    id_type = plain.schema["doc_id"].dataType
    out = None
    for block in range(n_blocks):
        mine = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        rows = [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast((rows, whole))
        part = plain.mapInArrow(_matcher(sent, threshold), f"doc_id {id_type.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        out = part if out is None else out.union(part)
    return out.where((F.col("question_overlap") >= share) & (F.col("answer_overlap") >= share))


def _statistics(tests: DataFrame) -> tuple[int, dict[int, int], float]:
    """Units, units by term and words a unit of a whole benchmark; the table of terms grows with the benchmark's vocabulary only."""

    def terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for t in part.column("text"):
                words = _words(t.as_py() or "")
                if not len(words):
                    continue
                for piece in np.array_split(words, max(1, -(-len(words) // UNIT))):
                    own = np.unique(piece)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.where(np.arange(len(own)) == 0, len(piece), 0))], names=["term", "words"])

    rows = tests.mapInArrow(terms, "term long, words long")
    counts = rows.groupBy("term").agg(F.count("*").alias("n")).toPandas()
    total = rows.agg(F.sum("words").alias("words"), F.sum((F.col("words") > 0).cast("long")).alias("units")).first()
    return total.units, dict(zip(counts["term"].to_numpy(np.int64).view(np.uint64).tolist(), counts["n"].tolist(), strict=True)), total.words / max(1, total.units)


def _matcher(sent, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, (n_units, df, mean) = sent.value
        index = build_index(rows, n_units, df, mean)
        for part in parts:
            at, found = [], []
            for i, t in enumerate(part.column("text").cast(pa.binary())):
                if data := t.as_py():
                    hits = verify(index, data, search(index, data, threshold))
                    at += [i] * len(hits)
                    found += hits
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which no item was found. Each row is judged by its own text (``shared.row_keys``): of rows that share a
    doc_id only those that hold an item go, and so does a row without doc_id that holds one."""
    names = [f"keep_{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed, _ = row_keys(docs.toDF(*names), Scratch(docs.sparkSession), doc_id, text)
    found = leaks(keyed.select(F.col("row_key").alias("doc_id"), F.col(text).alias("text")), items, **options).select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(found, "row_key", "left_anti").select(*names).toDF(*docs.columns)
