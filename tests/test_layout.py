"""Segmentation, pieces of spans, running headers, places of sentences and collation on made rows, and against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmatch.functions import similarity as sim
from weftmatch.operators import boxes as bx
from weftmatch.operators import headers as hd
from weftmatch.operators import locating as lo
from weftmatch.operators import segmentation as sg
from weftmatch.operators import spans as sp
from weftmatch.plans import layout

SF = "/root/testdata/sf0.001"


def test_word_list_ignores_blank_lines_and_case(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Và \n\n  là\nvà\nhệ  thống\n", encoding="utf-8")
    assert sorted(r.word for r in sg.word_list(spark, f"file://{tmp_path}/words.txt").collect()) == ["hệ thống", "là", "và"]


def test_longest_phrase_wins():
    known = {"hệ thống", "hệ thống thông tin", "thông tin", "tin học"}
    assert sg.cover("hệ thống thông tin học".split(), known) == ["hệ_thống_thông_tin", "học"]
    assert sg.cover("một hệ thống tin học".split(), known) == ["một", "hệ_thống", "tin_học"] and sg.cover([], known) == []


def test_sent_and_joined_dictionaries_agree(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.choice("abc") for _ in range(rng.randint(0, 25))]) for i in range(120)] + [(500, None), (501, ["a", "b"]), (501, ["a", "b"])], "id int, words array<string>")
    known = spark.createDataFrame([("a b",), ("b c a",), ("a b c c",), ("x y",)], "phrase string")
    key = lambda df: sorted((r.id, r.segments) for r in df.collect() if r.words is not None)
    sent = key(sg.segmented(rows, "words", known))
    monkeypatch.setattr(sg, "SENT_BYTES", 0)
    joined = sg.segmented(rows, "words", known)
    assert key(joined) == sent and joined.count() == 123 and ["a_b"] in [s for _, s in sent]
    assert all("_".join(s).replace("_", "") == "".join(s).replace("_", "") for _, s in sent)


def test_phrases_are_learnt_within_lines_once_a_row(spark):
    docs = spark.createDataFrame([(1, "a b c\nd a b a b"), (2, "x a b"), (3, None)], "id int, text string")
    got = {r.phrase for r in sg.learnt_phrases(docs, F.split("text", "\n"), 2).collect()}
    assert got == {"a b"}
    assert {r.word for r in sg.frequent_words(docs, "id", "text", 60).collect()} == {"a", "b"}


def test_pieces_of_spans_like_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), a := rng.randrange(30), a + rng.randrange(8), rng.randrange(5)) for _ in range(90)]
    got = sorted(tuple(r) for r in sp.elementary(spark.createDataFrame(rows, "doc_id int, a int, b int, who int"), "doc_id", "a", "b", "who").collect())
    want = set()
    for doc in range(4):
        own = [r for r in rows if r[0] == doc]
        edges = sorted({r[1] for r in own} | {r[2] + 1 for r in own})
        for lo_, hi in zip(edges, edges[1:]):
            want |= {(doc, lo_, hi - 1, r[3]) for r in own if r[1] <= lo_ and hi - 1 <= r[2]}
    assert got == sorted(want)


def test_running_headers_and_page_numbers_go(spark):
    long = "một dòng chữ dài như một dòng đầy của trang in nên còn tiếp tục ở dưới"
    lines = ["Trường A", "1", long, "và hết ở đây.", "Trường A", "2", "Câu lặp.", "Câu lặp.", "Câu lặp.", " Trường  A ", "MỤC LỚN CỦA BÀI", long, "Hình 1: ảnh", "", "hai lần", "hai lần"]
    docs = spark.createDataFrame([(1, lines), (2, []), (3, ["x", "x", "x"])], "id int, lines array<string>")
    got = {r.id: r for r in hd.join_widths(hd.without_page_marks(docs, "lines", "kept"), "kept", "joined").collect()}
    assert got[1].joined == [long + " và hết ở đây.", "Câu lặp.", "Câu lặp.", "Câu lặp.", "MỤC LỚN CỦA BÀI", long, "Hình 1: ảnh", "hai lần", "hai lần"]
    assert got[2].joined == [] and got[3].kept == []


def test_widths_joined_like_a_plain_loop(spark):
    rng, parts = random.Random(6), ["x" * 64, "chữ ngắn", "Hết câu " + "y" * 60 + ".", "TIÊU ĐỀ LỚN HƠN", "- ý", "1. mục", "\x01BG\x02" + "z" * 70, "dấu " * 16 + ":"]
    many = [[rng.choice(parts) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    opens, apart = {"TIÊU ĐỀ LỚN HƠN", "- ý", "1. mục"}, {"TIÊU ĐỀ LỚN HƠN"}
    want = []
    for lines in many:
        out, last = [], None
        for line in map(str.strip, lines):
            if last and last[-1] not in ".!?:;" and first not in apart and "\x01" not in first + line and len(out[-1]) >= 60 and line not in opens:
                out[-1] += " " + line
            else:
                out.append(line)
                first = line
            last = line
        want.append(out)
    docs = spark.createDataFrame([(i, [x.strip() for x in lines]) for i, lines in enumerate(many)], "id int, lines array<string>")
    assert [r.joined for r in hd.join_widths(docs, "lines", "joined").orderBy("id").collect()] == want


def dice(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    if a == b:
        return 1.0
    left = [b[i : i + 2] for i in range(len(b) - 1)]
    shared = 0
    for i in range(len(a) - 1):
        if a[i : i + 2] in left:
            left.remove(a[i : i + 2])
            shared += 1
    return 2 * shared / (len(a) + len(b) - 2)


def test_pairs_of_characters(spark):
    pairs = [("night", "nacht"), ("aaaa", "aa"), ("con đường làng", "con đường lang"), ("ab", "ab")]
    got = spark.createDataFrame(pairs, "a string, b string").select(sim.dice_bigrams(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([dice(a, b) for a, b in pairs])


def test_sentences_are_found_where_they_stand(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(60)}" for _ in range(900)]
    sought = {1: words[100:120], 2: words[295:310], 3: [*words[500:508], "other", *words[509:520]], 4: ["never", "seen", "words", "here"], 5: ["w1", "w2"]}
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[290:330] * 2)), (3, None), (4, ""), (5, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in sought.items()], "item_id long, text string")
    for sent in (lo.SENT_BYTES, 0):
        lo.SENT_BYTES, keep = sent, lo.SENT_BYTES
        got = {(r.doc_id, r.item_id): r for r in lo.locate(docs, items).collect()}
        lo.SENT_BYTES = keep
        assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 2)}
        assert (got[1, 1].start, got[1, 1].score, got[1, 1].page, got[1, 1].end_page) == (100, 1.0, 1, 1)
        assert (got[1, 2].page, got[1, 2].end_page) == (1, 2) and got[2, 2].start == 5
        assert got[1, 3].start == 500 and got[1, 3].score == pytest.approx(dice(" ".join(words[500:520]), " ".join(sought[3])))


def test_points_inside_rectangles_like_a_plain_loop(spark):
    rng = random.Random(12)
    points = [(p, i, rng.uniform(-50, 400), rng.uniform(-50, 400)) for p in range(3) for i in range(150)] + [(0, 900, 98.0, 98.0), (0, 901, 97.9, 98.0)]
    tables = [(rng.randrange(3), x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(0, 150), y + rng.uniform(0, 90)) for _ in range(8)] + [(0, 100.0, 100.0, 110.0, 110.0), (0, 100.0, 100.0, 110.0, 110.0)]
    got = bx.inside(spark.createDataFrame(points, "page int, i int, x double, y double"), spark.createDataFrame(tables, "page int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    want = {(p, i) for p, i, x, y in points if any(q == p and x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2 for q, x0, y0, x1, y1 in tables)}
    rows = [(r.page, r.i) for r in got.collect()]
    assert sorted(rows) == sorted(want) and (0, 900) in want and len(rows) == len(set(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_of_boxes_follow_their_first_box(spark):
    # each box is near the one before; the third is too far from the first, which holds the line
    boxes = [(1, 0, 0.0, 100.0, 10.0, 10.0), (1, 1, 12.0, 105.0, 10.0, 10.0), (1, 2, 24.0, 110.0, 10.0, 10.0), (1, 3, 50.0, 101.0, 0.0, 10.0), (1, 4, 60.0, 109.0, 5.0, 20.0), (2, 0, 0.0, 5.0, 9.0, 0.5)]
    frame = spark.createDataFrame(boxes, "page int, place int, x double, y double, width double, height double")
    got = {(r.page, r.line): (r.y, r.x_from, r.x_to, r.n) for r in bx.lines_of_boxes(frame, ["page"]).collect()}
    assert got == {(1, 0): (100.0, 0.0, 65.0, 3), (1, 1): (110.0, 24.0, 34.0, 1), (2, 0): (5.0, 0.0, 9.0, 1)}
    heights = spark.createDataFrame([(1, 110.0)], "page int, page_height double")
    assert sorted((r.page, r.place) for r in bx.without_bands(frame, heights, ["page"]).collect()) == [(2, 0)]


def test_vietnamese_order(spark):
    titles = ["Đường", "dù", "Ăn", "an", "Âm", "Ô", "ơn", "ong", "Bà", "ba", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").withColumn("k", F.collate("t", "vi_CI_AI"))
    up = [r.t for r in rows.orderBy(F.asc_nulls_last("k"), "i").collect()]
    assert up == ["an", "Ăn", "Âm", "Bà", "ba", "dù", "Đường", "ong", "Ô", "ơn", None]
    assert rows.orderBy(F.desc_nulls_last("k"), "i").collect()[-1].t is None


@pytest.mark.parametrize("name", [n for n in layout.ORACLES if n != "elementary_spans"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(layout.ORACLES[name])
    names = [c[0] for c in want.description]
    tidy = lambda rows: sorted(tuple("" if x is None else f"{float(x):.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)
    assert tidy(layout.QUERIES[name](spark, SF).select(*names).collect()) == tidy(want.fetchall())
