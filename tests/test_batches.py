"""Functions of whole batches against plain loops."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftmatch.functions import text as tx


def _hash(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % 1_000_000_007
    return h


def test_runs_and_fingerprints_of_a_batch():
    r = random.Random(1)
    rows = [[r.choice(["a", "bê", "chữ", "𝔘x", "long" * 9]) for _ in range(r.randrange(9))] for _ in range(300)] + [None, []]
    for k in (1, 3, 5):
        want = [None if t is None else [_hash(" ".join(t[i : i + k])) for i in range(max(len(t) - k + 1, min(len(t), 1)))] for t in rows]
        assert tx.hashed_runs(pa.array(rows, pa.list_(pa.string())), k).to_pylist() == want
    lists = [None if t is None else [r.randrange(5) for _ in t] for t in rows]
    for w in (1, 4):
        want = []
        for h in lists:
            places = [] if not h else [h.index(min(h))] if len(h) < w else [max(i for i in range(j, j + w) if h[i] == min(h[j : j + w])) for j in range(len(h) - w + 1)]
            want.append(None if h is None else [h[p] for p in sorted(set(places))])
        assert tx.winnowed(pa.array(lists, pa.list_(pa.int64())), w).to_pylist() == want


def test_string_hash_of_a_batch():
    def plain(t):
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h)

    rows = ["", None, "abc", "đường " * 40, "𝔘" * 7, "z" * 500]
    assert tx.summed_units(pa.array(rows)).to_pylist() == [None if t is None else plain(t) for t in rows]


def test_marks_that_end_no_sentence(spark):
    texts = {"See Dr. Who. Then (TP. Hue) 3. Next? Yes": 3, "A 12. The end. B. C": 2, "... Why. (e.g. This) is. -vs. That": 3, "12. A": 1, "x ... Y": 2, "a.. B": 2, "": 0}
    rows = spark.createDataFrame(list(texts.items()), "t string, n int").select("t", "n", tx.split_sentences(F.col("t")).alias("s")).collect()
    assert [(r.t, len(r.s)) for r in rows] == [(r.t, r.n) for r in rows]
