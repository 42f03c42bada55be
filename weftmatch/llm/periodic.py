"""Periodic runs of words: stretches in which words some distance apart are identical.

A run has a smallest period q and a length of at least ``max(min_length, min_exponent * q)``, and no neighbouring word
extends it with that period. Every run of two periods or more holds a Lyndon word of length q under one of the two
orders of words (any order and its reverse), and that word is the longest Lyndon word at its place. So each text is
scanned once from right to left under either order: the chain of next smaller suffixes serves as the stack, and gives
the longest Lyndon word at each place. Its length is a candidate period, which is extended both ways.

Two suffixes are compared by their first words; where these are equal, the longest common extension is found by binary
search over rolling hashes (modulo 2**64) and verified word by word, so a collision costs time and no correctness.
What is verified for a distance is remembered, so that a stretch is not gone through again from each of its places.
No suffix array is built, and memory is linear in the text.

Defined results: a null text has no words, no runs and an empty collapsed text. Words are separated by ASCII white
space only. Repeated rows are scanned each for itself; ids play no part. An empty table gives an empty table. A text
lies in one task, whatever its length. Columns named in ``keep`` are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: words compared one by one before hashes are asked, and bytes of collapsed text a batch that goes out
DIRECT, OUT_BYTES = 8, 8 << 20
_STEP = 0x9E3779B97F4A7C15

RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


class Extensions:
    """Longest common extensions within one sequence of word numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.array = np.array(words, np.int64)
        #: distance -> last stretch [from, to) of places that equal the word at that distance, ended by an unequal one
        self.known: dict[int, tuple[int, int]] = {}
        self.sums: np.ndarray | None = None

    def _hashes(self) -> tuple[list[int], list[int]]:
        if self.sums is None:
            with np.errstate(over="ignore"):
                mixed = (self.array.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
                mixed ^= mixed >> np.uint64(29)
                power = np.ones(self.n + 1, np.uint64)
                power[1:] = np.uint64(0xD6E8FEB86659FD93)
                self.power = np.cumprod(power)
                self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.power[:-1])))
        return self.sums, self.power

    def _same(self, i: int, j: int, size: int) -> bool:
        """By hash: the ``size`` words from i on equal those from j > i on."""
        sums, power = self._hashes()
        return (int(sums[i + size]) - int(sums[i])) * int(power[j - i]) % 2**64 == (int(sums[j + size]) - int(sums[j])) % 2**64

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j > i on."""
        words, most = self.words, self.n - j
        size, direct = 0, min(most, DIRECT)
        while size < direct and words[i + size] == words[j + size]:
            size += 1
        if size < direct or size == most:
            return size
        begin, end = self.known.get(j - i, (0, -1))
        if begin - size <= i < end:
            self.known[j - i] = (min(i, begin), end)
            return end - i
        low, high = size, most + 1
        while high - low > 1:
            middle = (low + high) // 2
            if self._same(i, j, middle):
                low = middle
            else:
                high = middle
        # verified word by word, as far as this distance has not been before
        upto = begin if i < begin <= i + low else i + low
        wrong = np.flatnonzero(self.array[i:upto] != self.array[j : upto + j - i])
        end = i + int(wrong[0]) if len(wrong) else end if upto == begin else i + low
        self.known[j - i] = (i, end)
        return end - i

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j > i."""
        words, size, direct = self.words, 0, min(i, DIRECT)
        while size < direct and words[i - size - 1] == words[j - size - 1]:
            size += 1
        if size < direct or size == i:
            return size
        low, high = size, i + 1
        while high - low > 1:
            middle = (low + high) // 2
            if self._same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle
        wrong = np.flatnonzero(self.array[i - low : i] != self.array[j - low : j])
        return low - 1 - int(wrong[-1]) if len(wrong) else low


def longest_lyndon(values: list[int], right) -> list[int]:
    """Where the longest Lyndon word at each place ends: the next suffix that is smaller. A text's end is smaller than any word."""
    n = len(values)
    values = [*values, -(n + 2)]
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        own, j = values[i], i + 1
        while True:
            other = values[j]
            if other < own:
                break
            if other == own:
                a, b = values[i + 1], values[j + 1]
                if a == b:
                    size = right(i, j)
                    a, b = values[i + size], values[j + size]
                if b < a:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers from 0 on, by start and period; ``min_exponent`` is 3 or more."""
    n = len(words)
    if min_exponent < 3:
        raise ValueError("min_exponent is 3 or more")
    if n < max(min_length, min_exponent):
        return []
    ext = Extensions(words)
    array, place = ext.array, np.arange(n)
    found: set[tuple[int, int, int]] = set()
    for values in (words, [-x for x in words]):
        ends = np.array(longest_lyndon(values, ext.right), np.int64)
        period = ends - place
        # of a run's Lyndon words the first begins within its first period, with min_exponent - 1 periods after that begin
        reach = (min_exponent - 1) * period
        hit = np.flatnonzero(place + reach <= n)
        i, p, last = hit, period[hit], reach[hit] - 1
        hit = hit[(array[i] == array[i + p]) & (array[i + last] == array[i + last - p])]
        done: dict[int, int] = {}
        for i, p in zip(hit.tolist(), period[hit].tolist(), strict=True):
            if i >= done.get(p, 0):
                after = ext.right(i, i + p)
                done[p] = i + after + 1
                if after >= (min_exponent - 2) * p:
                    before = ext.left(i, i + p)
                    length = before + after + p
                    if length >= max(min_length, min_exponent * p):
                        found.add((i - before, length, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that lie in no run after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()])


def find_runs(docs: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Columns ``keep``, n_words (long), runs (start, length and period of each, by start and period) and collapsed (the text without repeats)."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    schema = T.StructType(plain.schema.fields[:-1] + added)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text_").cast(pa.binary())
            at, size, n_words, runs, rest = 0, 0, [], [], []
            for i, text in enumerate(texts):
                words = (text.as_py() or b"").split()
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                own = runs_of([number[w] for w in words], min_length, min_exponent)
                n_words.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                rest.append(collapsed(words, own))
                size += len(rest[-1])
                if size > OUT_BYTES or i + 1 == len(texts):
                    columns = [pa.array(n_words, pa.int64()), pa.array(runs, _RUNS), pa.array(rest, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.slice(at, i + 1 - at).columns[:-1], *columns], names=schema.names)
                    at, size, n_words, runs, rest = i + 1, 0, [], [], []

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
