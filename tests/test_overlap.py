"""The engine's queries against DuckDB on the smallest tables, and operators on made rows."""

import itertools
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftmatch.config import EngineConfig, resolve_threshold
from weftmatch.functions import similarity as sim
from weftmatch.functions import text as tx
from weftmatch.operators import matching as m
from weftmatch.operators import sentences as st
from weftmatch.operators import sequences as sq
from weftmatch.operators import statistics as stats
from weftmatch.plans import overlap, records

SF = "/root/testdata/sf0.001"
TABLES = sorted(p.name.removesuffix(".parquet") for p in Path(SF).iterdir())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    as_text = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(as_text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(overlap.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = overlap.QUERIES[name](spark, SF).toPandas(), duck.execute(overlap.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


def test_every_key_of_sql_is_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_document_passages_by_brute_force(spark):
    found = overlap.passages_final(spark, SF).toPandas()
    want = {}
    for doc, rows in found.groupby("doc_id"):
        taken = []
        for r in sorted(rows.itertuples(), key=lambda r: (-r.n, r.t_from, r.source_doc)):
            if not any(a <= r.t_to and r.t_from <= b for a, b in taken):
                taken.append((r.t_from, r.t_to))
        want[doc] = len(taken)
    assert {r.doc_id: r.n_passages for r in overlap.doc_passage_count(spark, SF).collect()} == want


def _matches(spark, rows):
    full = [(1, t, d, s, p, q, 1.0, "t", "s", 5) for t, d, s, p, q in rows]
    return spark.createDataFrame(full, "doc_id long, idx int, source_doc long, source_idx int, paragraph_id string, source_paragraph_id string, similarity double, target_text string, source_text string, n_words int")


def test_three_in_a_row_make_one_passage(spark):
    m = _matches(spark, [(1, 2, 10, "P", "P"), (2, 2, 11, "P", "P"), (3, 2, 12, "P", "P")])
    found = sq.passages(m)
    assert [tuple(r) for r in found.select("source_doc", "t_from", "t_to", "s_from", "s_to", "n").collect()] == [(2, 1, 3, 10, 12, 3)]
    assert sq.patchworks(m, sq.covered(found)).count() == 0
    assert sq.remainder(m, found, sq.patchworks(m, sq.covered(found))).count() == 0


def test_a_new_paragraph_ends_a_passage(spark):
    m = _matches(spark, [(1, 2, 10, "P", "P"), (2, 2, 11, "P", "P"), (3, 2, 12, "Q", "P"), (4, 2, 13, "Q", "P")])
    assert sorted((r.t_from, r.t_to) for r in sq.passages(m).collect()) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("rows, n_sources", [([(1, 2, 10), (2, 3, 100), (3, 4, 20)], 3), ([(1, 2, 10), (2, 2, 50), (3, 2, 90)], 1)])
def test_patchworks(spark, rows, n_sources):
    m = _matches(spark, [(*r, "P", "P") for r in rows])
    found = sq.passages(m)
    patched = sq.patchworks(m, sq.covered(found)).collect()
    assert found.count() == 0 and [(r.t_from, r.t_to, r.n, r.n_sources) for r in patched] == [(1, 3, 3, n_sources)]


def test_spans_that_overlap_keep_the_longest(spark):
    rows = [(1, 1, 4, 4), (1, 3, 9, 7), (1, 10, 11, 2), (1, 9, 10, 2)]
    df = spark.createDataFrame(rows, "doc_id long, t_from int, t_to int, n int")
    out = sq.greedy(df, ["doc_id"], [-F.col("n"), F.col("t_from")], ["t_from", "t_to", "n"])
    assert sorted((r.t_from, r.t_to) for r in out.collect()) == [(3, 9), (10, 11)]


@pytest.mark.parametrize("words, copy", [(1000, True), (850, True), (600, False), (500, False)])
def test_whole_copy(spark, words, copy):
    df = spark.createDataFrame([(1, 2, words, words / 10.0)], "doc_id long, source_doc long, matched_words long, coverage_pct double")
    assert (stats.whole_copies(df).count() == 1) == copy


@pytest.mark.parametrize("text, want", [("abc", 96354), ("ư", 432), ("", 0)])
def test_poly_hash(spark, text, want):
    assert spark.range(1).select(tx.poly_hash(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(
    "text, hashes, prints",
    [
        ("the quick brown fox jumps over the lazy dog", [804076289, 214673130, 201878981, 787455022, 4188018, 815229656, 988848282], [201878981, 4188018]),
        ("the quick brown fox leaps over the lazy dog", [804076289, 214673130, 203237835, 623535655, 27516492, 815229656, 988848282], [203237835, 27516492]),
        ("xin chào", [883371636], [883371636]),
    ],
)
def test_fingerprints(spark, text, hashes, prints):
    h = tx.kgram_hashes(tx.words(F.lit(text)))
    got = spark.range(1).select(h.alias("h"), tx.fingerprints(h).alias("f")).first()
    assert got.h == hashes and got.f == prints


def test_similarities_are_symmetric_and_bounded(spark):
    sets = [[], ["a"], ["a", "b"], ["b", "c", "d"]]
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(sets, sets)], "a array<string>, b array<string>")
    for r in df.select("a", "b", sim.set_similarity(F.col("a"), F.col("b")).alias("x"), sim.set_similarity(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and (r.x == 1) == (bool(r.a) and r.a == r.b)


@pytest.mark.parametrize("spec, want", [("5", list(range(5, 31))), ("10-25", list(range(10, 26))), ("1-5, 8, 11-13", [1, 2, 3, 4, 5, 8, 11, 12, 13]), ("25-10", list(range(10, 26))), ("abc", [])])
def test_page_ranges(spark, spec, want):
    assert spark.range(1).select(tx.parse_page_range(F.lit(spec), F.lit(30))).first()[0] == want


@pytest.mark.parametrize("text, n", [("Tôi thực tập ở đây. Chị dạy tôi.", 2), ("Doanh thu là 1.5 tỷ đồng.", 1), ("Ở TP. Hồ Chí Minh.", 1)])
def test_sentences(spark, text, n):
    assert len(spark.range(1).select(tx.split_sentences(F.lit(text))).first()[0]) == n


def test_settings():
    assert EngineConfig().problems() == []
    assert EngineConfig(threshold=0.05).problems() and EngineConfig(max_size="101MB").problems() and EngineConfig(enabled=frozenset({"cosine"})).problems()
    assert EngineConfig(enabled=frozenset()).weight("cosine") == 0.4
    assert (resolve_threshold(None, None), resolve_threshold(None, EngineConfig()), resolve_threshold(0.3, None)) == (0.5, 0.6, 0.3)


def test_paragraph_numbers_of_four_digits(spark):
    df = spark.createDataFrame([(1, "\n".join(["Some words stand here."] * 1001), False)], "doc_id long, text string, is_sample boolean")
    got = [r.paragraph_id for r in st.sentences(df).orderBy("idx").collect()]
    assert got == [f"DOAN_{i:03}" for i in range(1, 1002)]


def _made_index(spark, seed):
    """Submissions and samples of very few texts, often repeated, and near matches of the texts that no sample has."""
    rng, rows, near = random.Random(seed), [], []
    for doc in range(14):
        is_sample = doc >= 5
        paragraph = 1
        for idx in range(1, rng.randint(2, 16)):
            paragraph += rng.random() < 0.2
            text = rng.choice("abc" if is_sample else "abcXY")
            rows.append((doc, is_sample, idx, f"P{paragraph}", text, 3, text))
    for doc, is_sample, idx, _, text, _, _ in rows:
        if not is_sample and text in "XY":
            near += [(doc, idx, r[0], r[2], s, s, s, s) for r in rows if r[1] and rng.random() < 0.3 for s in [rng.choice([0.6, 0.75])]]
    index = spark.createDataFrame(rows, "doc_id long, is_sample boolean, idx int, paragraph_id string, sentence_hash string, token_count int, content string")
    return index, spark.createDataFrame(near, "doc_id long, idx int, source_doc long, source_idx int, similarity double, cosine double, winnowing double, jaccard double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_and_patchworks_of_copies_equal_those_of_all_matches(spark, seed):
    index, near = _made_index(spark, seed)
    every, rows = m.with_texts(index, m.all_matches(index, near)), m.matched(index, near)
    tidy = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    names = ["doc_id", "source_doc", *sq.PASSAGE]
    islands = sq.passage_islands_of_copies(rows, near, index)
    want = tidy(sq.passage_islands(every).select(*names))
    assert want and tidy(islands.select(*names)) == want
    # a few passages only are taken as covered, so that runs are left for patchworks
    inside = sq.covered(sq.best_islands(islands).where("n >= 4"))
    runs = sq.patchwork_runs(rows, inside)
    patched = [tuple(r) for r in sq.patchworks(every, inside).collect()]
    assert patched and sorted(patched) == sorted(tuple(r) for r in sq.best_patchworks(sq.patchwork_islands(m.matches_of(index, near, runs), runs)).collect())
    assert tidy(rows.select("doc_id", "idx")) == tidy(every.select("doc_id", "idx").distinct())


def _texts_of_copies(spark, tmp_path, copies):
    """Two sentences that are near copies of each other, alone in many submissions and many samples; other texts give the words weight."""
    words = ["granite", "river", "window", "carpet", "lantern", "meadow", "copper", "violin", "harbor", "saddle", "timber", "orchid", "basalt", "pepper"]
    a, b = " ".join(words).capitalize() + ".", " ".join([*words[:-1], "ginger"]).capitalize() + "."
    rows = [(i, a, "src0") for i in range(copies)] + [(1000 + i, b, "src5") for i in range(copies)] + [(2000 + i, f"Nothing here is{chr(97 + i)} alike.", "src5") for i in range(20 + copies)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_copies_are_compared_once_and_given_all(spark, tmp_path):
    sf = _texts_of_copies(spark, tmp_path, 9)
    assert overlap._pairs(spark, sf).count() == 1
    for name in ("candidate_pairs", "candidate_min_overlap", "jaccard_pairs", "winnowing_pairs", "cosine_pairs", "sentence_matches"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
        mine, theirs = overlap.QUERIES[name](spark, sf).toPandas(), con.execute(overlap.ORACLES[name]).df()
        assert len(mine) == 81 and _rows(mine) == _rows(theirs)


def test_a_sentence_of_many_documents_makes_no_pairs_for_passages(spark, tmp_path):
    """Exact matches of lone sentences are as many as pairs of copies; passages are found, and stored, without them."""
    rows = [(i, "One common line of text.", "src0") for i in range(60)] + [(1000 + i, "One common line of text.", "src5") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found, passages, patched = overlap._spans(spark, str(tmp_path))
    assert (found.count(), passages.count(), patched.count()) == (60, 0, 0)
    assert {r.pages for r in records.page_ranges(spark, str(tmp_path)).collect()} == {"1"}


def test_totals_read_the_matched_sentences_given(spark):
    """The rows of matched sentences are used as they are: no pair is needed for them."""
    index, near = _made_index(spark, 1)
    every = m.all_matches(index, near)
    assert sorted(stats.report_stats(index, every, m.matched(index, near)).collect()) == sorted(stats.report_stats(index, every).collect())
