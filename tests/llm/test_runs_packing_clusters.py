"""Operators 11 to 13: runs against brute force, packing by an exact round trip, clusters against plain loops."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from weftmatch.llm import exponion, packing, periodic, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=6, min_exponent=4):
    """Every period in turn: maximal stretches of equal words, without those that have a smaller period."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        x = 0
        while x + q < len(words):
            begin = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            length = x - begin + q
            if x > begin and length >= max(min_length, min_exponent * q):
                own = words[begin : begin + length]
                if all(own[r:] != own[:-r] for r in range(1, q)):
                    found.append((begin, length, q))
            x += x == begin
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return [known[w] for w in words]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(600):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, rng.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        words = numbers(words * rng.choice([1, 1, 2, 5]))
        assert periodic.runs_of(words) == brute_runs(words)
        assert periodic.runs_of(words, 3, 3) == brute_runs(words, 3, 3)


def test_runs_when_every_hash_collides(monkeypatch):
    monkeypatch.setattr(periodic.Extensions, "_same", lambda self, i, j, size: True)
    rng = random.Random(9)
    for _ in range(100):
        part = [rng.randrange(2) for _ in range(rng.randint(9, 30))]
        words = numbers((part * 6)[: rng.randint(20, 120)] + [rng.randrange(3) for _ in range(20)])
        assert periodic.runs_of(words) == brute_runs(words)


def test_long_periodic_sequences_take_linear_memory_and_little_time():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 100_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic.runs_of([0] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of([i % 1000 for i in range(200_000)]) == [(0, 200_000, 1000)]
    # no word stands four times in a row in a Fibonacci word
    assert periodic.runs_of(fibonacci[-1]) == []


def test_query_of_runs_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 50_000), (5, "x x x x x x"), (5, "x x x x x x"), (None, "é é " * 6), (7, "a a a a a")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    got = periodic.find_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (0, 6, [(0, 6, 1)], "é é"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 100_000, [(0, 100_000, 2)], "a b"), (5, 6, [(0, 6, 1)], "x"), (5, 6, [(0, 6, 1)], "x"), (7, 5, [], "a a a a a"),
    ]
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs_of([0] * 9, min_exponent=2)


# 12


def test_differencing_leaves_nothing_out_and_is_nearly_equal():
    rng = random.Random(4)
    for windows in (1, 2, 7, 40):
        sizes = [rng.randint(1, 500) for _ in range(rng.randint(1, 300))]
        sums, of = packing.differencing(sizes, windows)
        assert sorted(i for own in of for i in own) == list(range(len(sizes)))
        assert [sum(sizes[i] for i in own) for own in of] == sums.tolist() and len(of) <= windows
        if len(sizes) > 5 * windows:
            assert sums[0] - (sums[-1] if len(sums) == windows else 0) <= 100


def test_differencing_of_the_textbook():
    # 8, 7, 6, 5, 4 in two parts: differencing ends at 16 against 14
    assert packing.differencing([8, 7, 6, 5, 4], 2)[0].tolist() == [16, 14]


@pytest.mark.parametrize("sizes", [[], [1], [1023] * 90, [600] * 400, [513] * 300, [1] * 5000, [1023, 1] * 40, list(range(1, 1024))])
def test_windows_hold_everything_within_capacity(sizes):
    windows = packing.pack(sizes, 1024)
    assert all(sum(n for _, _, n in w) <= 1024 for w in windows)
    spans = defaultdict(list)
    for w in windows:
        for i, start, n in w:
            spans[i].append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == size
    assert len(windows) <= math.ceil(sum(sizes) / 1024) * 1.03 + 1


def check_packing(pieces, whole):
    """``pieces``: rows with row number, start, length, doc_tokens, sequence_id, offset, ids; ``whole``: ids of each row."""
    spans, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[p.n].append(p)
        windows[p.sequence_id].append(p)
    assert set(spans) == set(whole)
    for n, own in spans.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert b"".join(bytes(p.ids) for p in own) == struct.pack(f"<{len(whole[n])}I", *whole[n])
        assert all(p.doc_tokens == len(whole[n]) and len(p.ids) == 4 * p.length for p in own)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 1024
    return len(windows), sum(len(x) for x in whole.values())


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def test_sequences_hold_each_id_once(spark, model):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").selectExpr("text", "doc_id AS n")
    whole = {r.n: [*model.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    got = packing.sequences(docs, queries.tokenizer("byte_bpe_50k.json"), keep=["n"]).collect()
    windows, ids = check_packing(got, whole)
    assert 1 - ids / (1024 * windows) < 0.015
    digest = {(r.doc_id, r.start): r for r in queries.op12_packing(spark, LARGER).collect()}
    for r in digest.values():
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *whole[r.doc_id][r.start : r.start + r.length]))
    assert sum(r.length for r in digest.values()) == ids


def test_sequences_of_odd_rows(spark, model):
    long = "word and other words " * 30_000
    rows = [(0, None, None), (1, 1, ""), (2, 1, "same"), (3, 1, "same"), (4, None, long), (5, 5, "tab\tand\nline  two")] + [(6 + i, 6, "copy of a text " * 130) for i in range(50)]
    docs = spark.createDataFrame([(n, i, t, 7, 8, b"x") for n, i, t in rows], "n int, doc_id long, text string, start long, length long, ids binary")
    whole = {n: [*model.encode(t or "", add_special_tokens=False).ids, 0] for n, _, t in rows}
    check_packing(packing.sequences(docs, queries.tokenizer("byte_bpe_50k.json"), keep=["n"]).collect(), whole)
    assert packing.sequences(docs.limit(0), queries.tokenizer("byte_bpe_50k.json")).count() == 0


# 13


def brute_clusters(rows, k, rounds, dims, scale=64.0):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        at = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(at)]
    return sorted((i if i is not None else -1, near(x)[1], near(x)[0]) for i, x in kept), at


@pytest.mark.parametrize("k, rounds, dims, spread", [(16, 3, 64, 1.0), (5, 6, 3, 0.06), (1, 2, 2, 1.0), (40, 4, 2, 0.05)])
def test_clusters_against_plain_loops(spark, k, rounds, dims, spread):
    rng = random.Random(k)
    # coarse values: many ties and equal vectors
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(dims)]) for i in range(250)]
    rows += [(rng.randrange(300), rows[rng.randrange(250)][1]) for _ in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centroids = exponion.cluster(table, k=k, rounds=rounds, dims=dims)
    want, at = brute_clusters(rows, k, rounds, dims)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    assert [r.centroid for r in centroids.orderBy("cluster").collect()] == at


def test_the_ball_spares_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (32, 8))
    x = (centres[rng.integers(0, 32, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    state = (np.full(4000, -1), np.zeros(4000, np.int64), np.full(4000, np.inf), np.full(4000, -1.0))
    first = exponion.Centroids(centres.astype(np.int64))
    first.assign(x, *state, exact=False)
    moved = exponion.Centroids(centres.astype(np.int64) + 2, first.at)
    assert moved.assign(x, *state, exact=False) < 4000
    moved.assign(x, *state, exact=True)
    every = ((x[:, None, :] - moved.at[None]) ** 2).sum(axis=2)
    assert (state[0] == every.argmin(axis=1)).all() and (state[1] == every.min(axis=1)).all()


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [0.5, -0.5]), (2, None), (3, [0.1]), (4, [0.1, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (None, [0.25, 0.25]), (1, [0.5, -0.5]), (7, [1e300, -1e300]), (8, [])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, x int")
    got, centroids = exponion.cluster(table, k=2, dims=2)
    assert sorted((r.vec_id or 0) for r in got.collect()) == [0, 1, 1, 7] and centroids.count() == 2
    none, at = exponion.cluster(table.limit(0), k=2, dims=2)
    assert none.count() == 0 and at.count() == 0


def test_query_of_clusters_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{LARGER}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_exponion"])
    names = [c[0] for c in want.description]
    assert sorted(queries.op13_exponion(spark, LARGER).select(*names).collect()) == sorted(want.fetchall())
