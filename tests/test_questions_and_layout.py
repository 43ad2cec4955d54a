"""Small cases of the question builders, composed chunkers and layout stages: nulls, blanks, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import queries as Q
from docloom.operators import chunking as C
from docloom.operators import layout as L
from docloom.operators import sections as S


def test_stems_are_those_of_the_published_algorithm():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect rate rate cease ceas controll control roll roll".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert Q.stem(word) == want, word
    assert [Q.stem(w) for w in ("", "a", "Über", "x1", "水泵")] == ["", "a", "Über", "x1", "水泵"]


def test_questions_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "what is "), (4, "how the pump opens a valve"), (5, "数据平台管理怎么做")], "id int, text string")
    assert {r.query_id for r in Q.weighted_terms(df, "id", "text").collect()} == {3, 4, 5} or {r.query_id for r in Q.weighted_terms(df, "id", "text").collect()} == {4, 5}
    assert [r.term for r in Q.weighted_terms(df.where("id = 4"), "id", "text").orderBy("pos").collect()] == ["pump", "opens", "valve"]
    assert [(r.first, r.second) for r in Q.neighbour_phrases(Q.weighted_terms(df.where("id = 4"), "id", "text")).collect()] == [("pump", "opens"), ("opens", "valve")]
    got = Q.ideographic_query(df.where("id = 5"), "id", "text").collect()
    assert {(r.kind, r.text) for r in got} == {("term", "数据平台管理做"), ("phrase", "数据 平台 管理做"), ("near", "数据 平台 管理做")}
    assert Q.stemmed(spark.createDataFrame([("cats",), ("cats",), (None,)], "word string")).collect()[0].stem == "cat"


def lines(spark, *texts):
    return C.lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))


def test_sections_and_their_headings(spark):
    rows = C.with_levels(lines(spark, "第1章 A\n第1节 B\nplain one\n12\nplain two\n第2节 C\n第2章 D\nlast", None, "", "only\nlone lines"), 1)
    got = {(r.doc_id, r.pos): (r.path, r.lone) for r in S.sections_under_headings(rows).collect()}
    assert got == {(0, 2): ("第1章 A\n第1节 B", False), (0, 4): ("第1章 A\n第1节 B", False), (0, 7): ("第2章 D", False), (3, 0): ("", True), (3, 1): ("", True)}
    merged = {(r.doc_id, r.chunk_no): r.text for r in S.hierarchical_merge(rows).collect()}
    assert merged[(3, 0)] == "only\nlone lines" and merged[(0, 0)].endswith("plain one") and len(merged) == 4
    assert {r.doc_id for r in S.law_or_book(lines(spark, "第1章 A\nx y", None, "", "only words")).collect()} == {0, 3}


def test_questions_rows_and_tags(spark):
    rows = lines(spark, "1. Why\nbecause\n2. How\nlike this\nand so", "no marks here", None)
    assert {r.doc_id: r.pattern for r in S.question_votes(rows).collect()} == {0: 5, 1: -1}
    assert [(r.question, r.answer) for r in S.question_sections(rows).orderBy("group").collect()] == [("1. Why", "because"), ("2. How", "like this\nand so")]
    df = spark.createDataFrame([(1, None, "a", " b "), (2, "", None, "c"), (3, "x", "y", "z")], "k int, p string, q string, r string")
    assert {r.k: (r.question, r.answer) for r in S.pairs_from_cells(df, "k", "p", "q", "r").collect()} == {1: ("a", "b"), 3: ("x", "y")}
    assert {r.k: r.tag_kwd for r in S.tagged(df.withColumn("t", F.lit("v1.2, ,b")), "p", "t").collect()} == {3: ["v1_2", "b"]}
    assert S.row_batches(df, "p", "k").collect()[0].text == "; ; x"
    imgs = spark.createDataFrame([(1, 2, "w " * 5, "i2"), (1, 1, "w " * 5, None), (1, 3, None, "i3")], "doc_id int, pos int, text string, image string")
    assert sorted((r.chunk, r.images) for r in S.merged_with_images(imgs, 6).collect()) == [(0, ["i2"]), (1, ["i3"])]


BOX = "doc_id string, page int, box_id string, x0 double, x1 double, top double, bottom double, text string, layoutno string, layout_type string"


@pytest.fixture()
def boxes(spark):
    rows = [
        ("d", 1, "a", 0.0, 100.0, 0.0, 10.0, "The valve is", "1", None), ("d", 1, "b", 0.0, 100.0, 12.0, 22.0, "open.", "1", None), ("d", 1, "c", 0.0, 100.0, 24.0, 34.0, " ", "1", None),
        ("d", 1, "e", 0.0, 100.0, 90.0, 100.0, "Next,", "1", None), ("d", 1, "p", 0.0, 9.0, 110.0, 120.0, "- 7", "1", None), ("d", 2, "f", 0.0, 100.0, 0.0, 10.0, "on a new page", "2", None), ("d", 2, "n", 0.0, 100.0, 20.0, 30.0, None, "2", None),
    ]
    return spark.createDataFrame(rows, BOX)


def test_lines_become_paragraphs_across_pages(spark, boxes):
    got = [r.text for r in L.merged_vertically(L.in_reading_order(boxes)).orderBy("group").collect()]
    assert got[0] == "The valve isopen." and got[-1].endswith("on a new page") and not any("- 7" in t for t in got)
    assert L.merged_vertically(L.in_reading_order(spark.createDataFrame([], BOX))).count() == 0


def test_bullets_leaders_and_layout(spark, boxes):
    bullets = spark.createDataFrame([("d", 1, c, 0.0, 9.0, 10.0 * i, 10.0 * i + 9, t, None, None) for i, (c, t) in enumerate([("a", "• x"), ("b", "• y"), ("c", "x"), ("e", "x2"), ("f", "• z"), ("g", "")])], BOX)
    assert [r.text for r in L.merged_by_bullet(L.in_reading_order(bullets)).orderBy("group").collect()] == ["• x\n• y", "x", "x2", "• z"]
    led = boxes.withColumn("text", F.when(F.col("page") == 1, "a ······ 3").otherwise(F.col("text")))
    assert {r.page for r in L.without_leader_pages(led).collect()} == {2}
    regions = spark.createDataFrame([("d", 1, "r1", "header", 0.0, 200.0, 0.0, 25.0), ("d", 1, "r2", "text", 0.0, 200.0, 0.0, 200.0), ("d", 2, "r3", "equation", 0.0, 200.0, 0.0, 15.0), ("d", 1, "r0", "unheard", 0.0, 200.0, 0.0, 200.0)], "doc_id string, page int, region_id string, kind string, x0 double, x1 double, top double, bottom double")
    got = {r.box_id: (r.layout_type, r.layoutno) for r in L.with_layout(boxes, regions, 800.0).collect()}
    assert got == {"c": ("text", "r2"), "e": ("text", "r2"), "p": ("text", "r2"), "f": ("figure", "r3"), "n": ("", None)}


def test_tables_from_cells(spark):
    cells = spark.createDataFrame([("t", "1", 0.0, 0.0, "A", 0, 0, True), ("t", "2", 50.0, 0.0, "B", 0, 2, True), ("t", "3", 0.0, 20.0, "x", 5, 0, False), ("t", "4", 0.0, 22.0, "y", 5, 0, None), ("t", "5", 50.0, 20.0, None, 5, 2, False)], "table_id string, box_id string, x0 double, top double, text string, row_no int, col_no int, header boolean")
    assert L.assembled_tables(cells).collect()[0].html == "<table><tr><th>A</th><th>B</th></tr><tr><td>x y</td><td></td></tr></table>"
