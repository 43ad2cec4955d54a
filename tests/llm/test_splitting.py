import re

import pytest

from docloom.functions.text import PY_TOKEN
from docloom.llm import splitting as S

SCHEMA = "item string, text string, limit int, overlap double, range_no string, start string"
count = lambda t: len(re.findall(PY_TOKEN, t))


def run(spark, text, limit, overlap=0.0):
    df = spark.createDataFrame([("x", text, limit, overlap, "clash", "clash")], SCHEMA)
    return sorted(S.pieces(df).collect(), key=lambda r: r.piece_no)


def sequential(text, limit, overlap):
    """The pieces of one pass over the whole text."""
    starts, marks, kinds = S.detect(text, 0, len(text))
    out, at, back = [], 0, S._back(overlap, limit)
    offset = lambda t: 0 if t == 0 else starts[t] if t < len(starts) else len(text)
    while at < len(starts):
        a, z = S.next_cut(at, len(starts), limit, back, marks, kinds)
        out.append((offset(a), offset(at), offset(z)))
        at = z
    return out


def sample(size):
    return "".join(f"Word{i} goes on{'.' if i % 7 == 0 else ''}{chr(10) * 2 if i % 40 == 0 else ' '}" + ("水泵" if i % 11 == 0 else "") for i in range(size // 14))


@pytest.mark.parametrize("overlap", [0.0, 0.2, 0.9])
@pytest.mark.parametrize("block,fan", [(1 << 16, 256), (64, 3)])
def test_pieces_are_those_of_one_pass_however_the_text_is_dealt(spark, overlap, block, fan):
    text, limit = sample(40_000), 60 if block > 64 else 4
    df = spark.createDataFrame([("x", text, limit, overlap, "clash", "clash")], SCHEMA)
    got = sorted(S.pieces(df, 500, block, fan).collect(), key=lambda r: r.piece_no)
    assert [r.piece_no for r in got] == list(range(len(got)))
    assert [(r.start, r.new, r.end) for r in got] == sequential(text, limit, overlap)
    assert "".join(text[r.new : r.end] for r in got).rstrip() == text.rstrip()
    for k, r in enumerate(got):
        assert r.text == text[r.start : r.end].rstrip()
        assert count(r.text) == r.n_tokens <= limit
        if k and overlap >= 0.25:
            assert r.start < r.new and text[r.start : r.new].strip() in got[k - 1].text


def test_files_are_cut_like_texts_though_no_task_reads_them_whole(spark, tmp_path):
    texts = {"a": sample(30_000), "b": "Grüße an 水泵 und mehr. " * 800 + " " * 9000 + "\n\n" + " " * 9000 + "ende\n" * 300, "c": "", "d": "kurz"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, encoding="utf-8")
    paths = [str(tmp_path / n) for n in texts]
    got = S.pieces_of_files(spark, paths, 8, 0.25, range_bytes=1000, block=128, fan=3).collect()
    for n, t in texts.items():
        mine = sorted((r for r in got if r.item == str(tmp_path / n)), key=lambda r: r.piece_no)
        assert [(r.start, r.new, r.end) for r in mine] == sequential(t, 8, 0.25)
        assert all(r.text == t[r.start : r.end].rstrip() for r in mine)


def test_texts_below_the_byte_bound_are_never_oversized(spark):
    for text in ["a b c d", "水泵水泵", "a水b泵", "é é é", " a b ", "一 二 三"]:
        for limit in range(1, 6):
            df = spark.createDataFrame([(text, limit)], "text string, limit int")
            assert df.select(S.may_exceed(df["text"], df["limit"])).first()[0] or count(text) <= limit


def test_boundaries_are_preferred(spark):
    text = "# One\n" + "a b c d e f g. " * 3 + "\n\n# Two\n" + "h i j k l m n. " * 3
    got = run(spark, text, 30)
    assert got[1].text.startswith("# Two")


def test_counts_straddle_ranges_like_whole_texts(spark):
    for text in ["", " ", "一二三", "abc def", "ab一cd 二", "longtokenwithoutanyspaceatall end", " x　y", None]:
        df = spark.createDataFrame([("x", text, 0, 0.0)], "item string, text string, limit int, overlap double")
        got = S.stitched(S.counted(S.ranges(df, 7, 3))).collect()
        assert (got[0].n_tokens if got else 0) == count(text or "")


def test_files_by_byte_range(spark, tmp_path):
    text = "Grüße an 水泵 und mehr. " * 500
    (tmp_path / "f.txt").write_text(text, encoding="utf-8")
    rows = S.file_ranges(spark, [str(tmp_path / "f.txt")], 1000, 64)
    assert S.stitched(S.counted(rows)).collect()[0].n_tokens == count(text)
    parts = sorted(rows.collect(), key=lambda r: r.range_no)
    assert "".join(r.slice[r.lead : r.lead + r.own] for r in parts) == text


def test_none_oversized(spark):
    assert S.pieces(spark.createDataFrame([("x", None, 5, 0.0, "", ""), ("y", "a b", 5, 0.0, "", "")], SCHEMA)).count() == 0
