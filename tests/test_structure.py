"""Lines of reports: classes, regions and joined lines on made rows, and joining against plain loops."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmatch.functions import lines as ln
from weftmatch.functions import text as tx
from weftmatch.operators import regions as rg
from weftmatch.plans import structure
from weftmatch.sources.lines import html_lines

SF = "/root/testdata/sf0.001"
PROSE = "Hệ thống quản lý đào tạo giúp sinh viên đăng ký môn học trực tuyến và theo dõi kết quả học tập của mình, đồng thời hỗ trợ giảng viên nhập điểm nhanh chóng hơn."

CLASSES = [
    ("12", "page_number"), ("CHƯƠNG 1: CƠ SỞ LÝ THUYẾT", "heading"), ("Mở đầu", "heading"), ("Phần mềm quản lý được xây dựng trên nền web.", "text"), ("Chương II", "heading"),
    ("TỔNG QUAN VỀ ĐỀ TÀI", "heading"), ("1.2 Quản lý tuyến bay ........ 12", "contents"), ("1.2.1 Quản lý tuyến bay 12", "contents"), ("Dự án và vị trí công việc 17", "contents"),
    ("Hệ thống được chia làm 2", "text"), ("Hình 1.2: Sơ đồ", "caption"), ("Figure 3", "caption"), ("Bộ phậnMàu đồng phụcGhi chú", "glued_row"), ("Họ và tên: Nguyễn Văn A", "profile"),
    ("Khoa Công nghệ thông tin", "profile"), ("Sơn Tây, ngày 26 tháng 06 năm 2024", "signature"), ("Vào ngày 26 tháng 6 năm 2024 công ty khai trương.", "text"), ("Nguyễn Văn An", "name"),
    ("V. Bố cục của đề tài", "outline"), ("tên cột", "table_label"), ("select", "key_word"), ("1.1 Ý nghĩa của banner", "sub_heading"), ("a) mục đích", "sub_heading"), ("", "empty"),
    ("1. Marketing và quảng cáo: trong lĩnh vực tiếp thị, hình ảnh đóng vai trò rất quan trọng đối với khách hàng.", "text"), (PROSE, "text"),
]


def test_class_of_each_line(spark):
    rows = spark.createDataFrame([(i, line, kind) for i, (line, kind) in enumerate(CLASSES)], "i int, line string, want string")
    t = ln.normal(ln.without_bullets(F.col("line")))
    got = rows.select("line", "want", ln.line_class(ln.label_of(F.col("line")), t).alias("got"), ln.kept_text(F.lit("text"), t).alias("kept")).collect()
    assert [(r.line, r.got) for r in got if r.got != r.want] == []
    assert next(r.kept for r in got if r.line.startswith("1. Marketing")).startswith("Marketing và")


def test_labels_come_before_rules(spark):
    row = spark.range(1).select(F.array(*[ln.labelled(x, F.lit("một dòng chữ thường.")) for x in ("TD", "ML", "BG", "CT", "HVB")], F.lit("một dòng chữ thường.")).alias("x"))
    kinds = row.select(F.transform("x", lambda line: ln.line_class(ln.label_of(line), ln.normal(line))), F.transform("x", ln.without_labels)).first()
    assert kinds[0] == ["heading", "contents", "table", "caption", "text_box", "text"] and set(kinds[1]) == {"một dòng chữ thường."}


@pytest.mark.parametrize("text, want", [("a  　b\t c", "a b c"), ("__MỤC LỤC__", "MỤC LỤC"), ("*** KẾT LUẬN ***", "KẾT LUẬN"), ("plain text, kept", "plain text, kept"), ("", "")])
def test_squeeze(spark, text, want):
    assert spark.range(1).select(tx.squeeze(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("line, want", [
    ("1.2.3 Tên", ("1.2.3", "Tên")), ("1.1Logo", ("1.1", "Logo")), ("IV. Phần", ("IV.", "Phần")), ("b) ý", ("b)", "ý")), ("2.", ("2.", "")), ("1.5 tỷ", ("1.5", "tỷ")), ("không có", None), ("3cm", None),
])
def test_numbering(spark, line, want):
    assert spark.range(1).select(ln.numbering(F.lit(line))).first()[0] == want


def test_lines_of_a_page(spark):
    html = "<html><title>Bìa</title><script>if (a<b) x()</script><nav><li>Mục <b>một</b></li></nav><!-- x --><h2>Chương 1</h2><p>Đoạn&nbsp;một<br>hai &lt;3</p><td>ô</td></html>"
    got = spark.range(1).select(html_lines(F.lit(html))).first()[0]
    assert [re.sub(r"\s+", " ", x).strip() for x in got] == ["\x01TD\x02Bìa", "\x01ML\x02Mục một", "\x01TD\x02Chương 1", "Đoạn một", "hai <3", "\x01BG\x02ô"]


def regions(spark, lines):
    return rg.with_regions(spark.createDataFrame([(1, lines)], "id int, lines array<string>")).select("regions", "compared").first()


def test_regions_of_a_report(spark):
    lines = ["TRƯỜNG ĐẠI HỌC A", "BÁO CÁO THỰC TẬP", "LỜI CẢM ƠN", "Em xin cảm ơn.", "MỤC LỤC", "Chương 1 Tổng quan", "Mở đầu", "Lý do", "CHƯƠNG 1", "Nội dung.", "TÀI LIỆU THAM KHẢO", PROSE, "KẾT LUẬN", "Hết."]
    got = regions(spark, lines)
    #   the first heading within the contents is an entry, the next opens the body
    assert got.regions == ["cover", "cover", "skipped", "skipped", "skipped", "skipped", "body", "body", "body", "body", "skipped", "skipped", "body", "body"]
    assert got.compared == [8, 9, 10, 13, 14]


def test_regions_end_where_prose_begins(spark):
    assert regions(spark, ["Tên đề tài", PROSE, "ngắn"]).regions == ["cover", "body", "body"]
    long = ["PHIẾU NHẬN XÉT", *["dòng ngắn"] * 39, PROSE, PROSE]
    assert regions(spark, long).regions[-2:] == ["skipped", "body"]
    # references reach to the end
    assert set(regions(spark, ["PHỤ LỤC", *["dòng"] * 50, PROSE]).regions) == {"skipped"}
    # automatic contents name their entries, so the first heading after them opens the body
    assert regions(spark, ["\x01ML\x02Chương 1", "\x01TD\x02Về công ty", "chữ"]).regions == ["cover", "cover", "cover"]
    assert regions(spark, ["\x01ML\x02Chương 1", "Chương 1", "chữ"]).regions == ["cover", "body", "body"]


def test_all_lines_are_compared_without_a_body(spark):
    assert regions(spark, ["a", "", "b"]).compared == [1, 2, 3] and regions(spark, []).compared == []
    assert regions(spark, ["12", "Chương 2"]).compared == [2]  # nothing after the heading


def joined(spark, fold, many):
    docs = spark.createDataFrame(list(enumerate(many)), "id int, lines array<string>")
    return [r.out for r in fold(docs, "lines", "out").orderBy("id").collect()]


def test_sentences_joined_like_a_plain_loop(spark):
    rng, parts = random.Random(1), ["chữ thường", "Chữ hoa đầu", "x" * 70, "Hết câu.", "", "- gạch đầu dòng", "CHƯƠNG 2", "2.1 Mục con", "Hình 1.1: Ảnh ", "MỤC LỤC 12", "dài " * 20, "Tên mục 12", "dấu:", "  "]
    many = [[rng.choice(parts) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    apart = {"Hình 1.1: Ảnh", "- gạch đầu dòng", "CHƯƠNG 2", "2.1 Mục con", "MỤC LỤC 12", "Tên mục 12"}
    want = []
    for lines in many:
        out = []
        for line in map(str.strip, lines):
            if not line:
                continue
            if out and out[-1][-1] not in ".!?:;" and line not in apart and (line[0].islower() or len(out[-1]) >= 60):
                out[-1] += " " + line
            else:
                out.append(line)
        want.append(out)
    assert joined(spark, rg.join_sentences, many) == want


def test_headings_joined_like_a_plain_loop(spark):
    rng, parts = random.Random(2), ["CHƯƠNG 1", "PHẦN II:", "CƠ SỞ LÝ THUYẾT", "Tên chương", "12", "chữ thường", "", "Câu.", "KẾT LUẬN"]
    many = [[rng.choice(parts) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    part, capitals = {"CHƯƠNG 1", "PHẦN II:", "CƠ SỞ LÝ THUYẾT", "Tên chương", "KẾT LUẬN"}, {"CHƯƠNG 1", "PHẦN II:", "CƠ SỞ LÝ THUYẾT", "KẾT LUẬN"}
    want = []
    for lines in many:
        out, i = [], 0
        while i < len(lines):
            if lines[i]:
                out.append(lines[i])
                if lines[i] in ("CHƯƠNG 1", "PHẦN II:"):
                    taken = 0
                    while taken < 3 and i + 1 < len(lines):
                        following = lines[i + 1]
                        if following == "12":
                            i += 1
                            continue
                        if following not in part or (taken and following not in capitals):
                            break
                        out[-1] += " " + following
                        i, taken = i + 1, taken + 1
            i += 1
        want.append(out)
    assert joined(spark, rg.join_headings, many) == want


def test_prepared_content(spark):
    lines = ["BÌA", "\x01CT\x02Hình 1", "Chương 1", "12", "TỔNG  QUAN", "Nội\tdung  một.", "\x01BG\x02ô", "Nội dung hai."]
    got = rg.prepared(spark.createDataFrame([(1, lines, 0)], "id int, lines array<string>, compared int")).first()
    assert got.content == ["Nội dung một.", "Nội dung hai."]


def test_very_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, ["một dòng chữ thường"] * 60_000), (2, []), (3, None)], "id int, lines array<string>")
    got = {r.id: (r.n, r.m) for r in rg.with_regions(rg.join_sentences(docs, "lines", "j")).select("id", F.size("j").alias("n"), F.size("compared").alias("m")).collect()}
    assert got[1] == (1, 60_000) and got[2] == (0, 0)


@pytest.mark.parametrize("name", list(structure.ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(structure.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(structure.QUERIES[name](spark, SF).select(*names).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["line_kinds", "line_class", "heading_keys"])
def test_lines_that_begin_with_dotted_figures_equal_their_sql(spark, tmp_path, name):
    lines = ["28.68.191.238, den Weg", "1.5kg Mehl", "3,5x", "3.5", "1.1Logo", "80.229.225.247. Der Rest", "10.0.0.1, " + "ein Satz. " * 20]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(structure.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(structure.QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == sorted(want.fetchall())
