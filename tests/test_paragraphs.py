"""Paragraphs rebuilt from where lines stand: made pages, a plain loop over random ones, and texts that come back."""

import hashlib
import random

from weftmatch.operators import paragraphs as pg
from weftmatch.plans import layout

SF = "/root/testdata/sf0.001"
SCHEMA = "id int, lines array<struct<page: int, page_height: double, y: double, x0: double, x1: double, text: string, in_table: boolean>>"


def rebuilt(spark, many):
    frame = spark.createDataFrame(list(enumerate(many)), SCHEMA)
    return [r.paragraphs for r in pg.rebuilt(frame, "lines").orderBy("id").collect()]


FULL = "một dòng đầy chạm tới mép phải của trang in"


def line(page, y, x0, x1, text, table=False):
    return (page, 800.0, float(y), float(x0), float(x1), text, table)


def test_rules_one_by_one(spark):
    page = [
        line(1, 790, 72, 150, "Trường A"), line(1, 700, 92, 500, FULL), line(1, 686, 72, 300, "phần còn lại."), line(1, 672, 92, 500, FULL), line(1, 658, 72, 498, FULL), line(1, 630, 72, 500, FULL),
        line(1, 616, 72, 500, "- " + FULL), line(1, 602, 72, 200, "Hình 1.1: ảnh"), line(1, 588, 72, 500, FULL), line(1, 560, 72, 500, "ô của bảng ở giữa trang", True), line(1, 546, 72, 500, FULL), line(1, 20, 250, 260, "1"),
        line(2, 790, 72, 150, "Trường A"), line(2, 700, 72, 200, "sang trang."), line(2, 686, 92, 500, FULL),
    ]
    assert rebuilt(spark, [page, [], None]) == [[
        "Trường A", f"{FULL} phần còn lại.", f"{FULL} {FULL}", FULL, f"- {FULL}", "Hình 1.1: ảnh", FULL, "\x01BG\x02ô của bảng ở giữa trang", f"{FULL} sang trang.", "1", "Trường A", FULL,
    ], [], None]


def plain(lines):
    """The same rules in plain loops over texts that have no captions and no numbers."""
    pick = lambda values, p: sorted(values)[int(p * (len(values) - 1))]
    gaps = [a[2] - b[2] for a, b in zip(lines, lines[1:]) if a[0] == b[0] and a[2] > b[2]]
    usual = pick(gaps, 0.5) if gaps else 20.0
    out, open_, waiting = [], None, []
    for r in lines:
        page, height, y, x0, x1, text, _ = r
        own = [q for q in lines if q[0] == page]
        told = [q for q in own if len(q[5]) >= 40] or own
        left, right = pick([q[3] for q in told], 0.1), pick([q[4] for q in told], 0.9)
        wide = max(right - left, 1.0)
        if (y > height * 0.955 or y < height * 0.045) and x1 - x0 < wide * 0.6:
            (waiting if open_ else out).append(text)
            continue
        if open_:
            full = open_["x1"] >= open_["right"] - wide * 0.04 or open_["x1"] + (x1 - x0) / len(text) * (len(text.split(" ")[0]) + 1) > open_["right"]
            if full and not text.startswith("- ") and x0 <= open_["left"] + 4 and (open_["page"] != page or open_["y"] - y <= usual * 1.45):
                open_.update(text=open_["text"] + " " + text, x1=x1, y=y, page=page, right=right, left=min(open_["left"], x0))
                continue
            out += [open_["text"], *waiting]
            waiting = []
        open_ = {"text": text, "x1": x1, "y": y, "page": page, "right": right, "left": x0}
    return out + ([open_["text"], *waiting] if open_ else [])


def test_like_a_plain_loop(spark):
    rng, many = random.Random(21), []
    for _ in range(120):
        lines, y, page = [], 780.0, 1
        for _ in range(rng.randint(0, 40)):
            y -= rng.choice([14, 14, 14, 18, 30])
            if y < 15:
                page, y = page + 1, 790.0
            text = rng.choice(["- ", "", "", ""]) + " ".join(rng.choice(["chữ", "dòng", "trang", "mép"]) for _ in range(rng.choice([3, 9, 12])))
            x0 = rng.choice([72.0, 72.0, 74.0, 92.0])
            lines.append((page, 800.0, y, x0, min(500.0, x0 + len(text) * rng.choice([8.0, 12.0])), text, False))
        many.append(lines)
    assert rebuilt(spark, many) == [plain(lines) for lines in many]


def test_most_texts_come_back(spark):
    got = {r.doc_id: r.text_md5 for r in layout.layout_paragraphs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()
    same = sum(hashlib.md5("\n".join(x for x in (p.strip(" ") for p in r.text.split("\n")) if x).encode()).hexdigest() == got[r.doc_id] for r in docs)
    assert len(got) == len(docs) and same >= 0.9 * len(docs)
