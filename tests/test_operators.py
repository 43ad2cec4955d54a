import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions.segment import merged_short, segment, segmented, with_synonyms
from docloom.operators import chunking as C
from docloom.operators import dag, mutation, nlsql
from docloom.operators import metadata as M
from docloom.operators import retrieval as R
from docloom.operators.research import align, research, shortened_reasoning
from docloom.sources import files as S


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).collect()[0].x


def test_lexical_edges(spark):
    for text, want in [(None, []), ("", []), ("  ", []), ("Ｈｅｌｌｏ, wörld_1!", ["hello", "wörld_1"]), ("水泵 pump", ["水泵", "pump"])]:
        assert one(spark, L.tokens("t"), t=text) == want
    assert one(spark, L.spaced_scripts("t"), t="用pump泵3号") == "用 pump 泵 3 号"
    assert one(spark, L.numeral("t"), t=" XII ") == 12 and one(spark, L.numeral("t"), t="七") == 7 and one(spark, L.numeral("t"), t=None) == -1
    assert one(spark, L.without_stop_phrases("t"), t="the of") == "the of"
    assert one(spark, L.bigrams(L.tokens("t")), t="one") == []
    assert L.delimiter_pattern("\n`ab`c") == "ab|\\\n|c"


def test_segmentation_and_synonyms(spark):
    words = {"数据": 5.0, "数据库": 9.0, "库": 1.0, "管理": 4.0}
    assert segment("数据库管理员", words) == ["数据库", "管理", "员"] and segment("", words) == []
    got = segmented(spark.createDataFrame([("数据库 Pump", 1), (None, 2)], "t string, k int"), "t", words).collect()
    assert [r.words for r in got] == [["数据库", "pump"], []]
    terms = spark.createDataFrame([("q", "car", 1.0)], "query_id string, term string, weight double")
    syn = spark.createDataFrame([("car", ["auto", "car"])], "term string, syn array<string>")
    assert {(r.term, r.weight) for r in with_synonyms(terms, syn).collect()} == {("car", 1.0), ("auto", 0.25)}
    assert one(spark, merged_short(F.split("t", " ")), t="a b pump c d e f g x1") == ["a b", "pump", "c d", "e f", "g x1"]


def test_vector_search_edges(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0 if i else 0.0]) for i in range(9)] + [(50, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id int, embedding array<double>")
    got = R.knn(q, v, 3).collect()
    assert {r.query_id for r in got} == {1} and [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [2, 5, 8]
    assert R.knn(q.limit(0), v, 3).count() == 0 and R.knn(q, v.limit(0), 3).count() == 0
    assert R.window_size(1) == 1 and R.window_size(30) == 90 and R.window_size(64) == 64


def test_folds_keep_all_text():
    sections = ["alpha beta", "", "gamma " * 30 + "。 tail", "x"]
    out = C.merge_fold(sections, 10)
    assert "".join("".join(out).split()).replace("。", "") == "".join("".join(sections).split()).replace("。", "")
    md = ["# A", "text " * 5, "| a | b |", "|---|---|", "| 1 | 2 |", "```", "# no heading", "```", "## B", "more"]
    got = C.markdown_fold(md, 3, 50)
    assert any("| a | b |\n|---|---|\n| 1 | 2 |" in c for c in got) and "\n".join(got) == "\n".join(md)
    assert C.merge_fold([], 5) == [] and C.size_controlled(["a"], 10) == ["a"]


def test_mutations(spark):
    t = dt.datetime
    df = spark.createDataFrame([("a", 1, t(2024, 1, 1), ["x"]), ("b", 2, t(2024, 1, 1), None)], "id string, v int, at timestamp, tags array<string>")
    new = spark.createDataFrame([("a", 9, t(2024, 1, 1), None), ("c", 3, None, ["y"])], df.schema)
    once = mutation.upsert(df, new, "id", "at")
    assert {(r.id, r.v) for r in once.collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert {(r.id, r.v) for r in mutation.upsert(once, new, "id", "at").collect()} == {(r.id, r.v) for r in once.collect()}
    assert {r.id: r.tags for r in mutation.add_element(df, F.lit(True), "tags", "z").collect()} == {"a": ["x", "z"], "b": ["z"]}
    with pytest.raises(ValueError):
        mutation.delete(df, [])
    assert [r.id for r in mutation.delete(df, ["a"]).collect()] == ["b"]
    assert M.where_terms(df, id=["a", "b"], v=None).count() == 2 and M.build_query(df, v=[2, None]).count() == 1


def test_guarded_sql():
    assert nlsql.guarded("SELECT a FROM t WHERE b = 'X;Y'; drop table t") == "select doc_id, a from t where b = 'X;Y'"
    assert nlsql.guarded("```sql\nselect * from t\n```", fields=["a", "b"]) == "select a, b from t"
    with pytest.raises(ValueError):
        nlsql.guarded("delete from t")
    assert "like 'a%'" in nlsql.token_matches("select 1 from t where name_kwd like 'a%'")


def test_flows(spark):
    flow = dag.Flow().add("a", lambda b: b, "b").add("b", lambda a: a, "a")
    with pytest.raises(ValueError, match="cycle"):
        flow.order()
    assert dag.repeated_path(["x", "y"] * 7) and not dag.repeated_path(["x", "y"] * 6)
    assert dag.safe_source("x = 1 + 1") and not dag.safe_source("import os") and not dag.safe_source("().__class__") and not dag.safe_source("def")


def test_files(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    mail = b"From: a@b.example\nSubject: s\nContent-Type: text/plain\n\nbody\n"
    rows = [("x.docx", buf.getvalue()), ("m.eml", mail), ("j.json", b'{"a": [1, {"b": 2}]}'), ("t.txt", "Grüße".encode("cp1252")), ("bad.docx", b"no zip"), ("n.txt", None)]
    got = {}
    for r in S.parse(spark.createDataFrame(rows, "path string, content binary")).collect():
        got.setdefault(r.path, []).append((r.kind, r.text))
    assert got["x.docx"] == [("paragraph", "Hello"), ("table", "h: v")]
    assert ("text", "body") in got["m.eml"] and got["j.json"] == [("json", '{"a": {"0": 1, "1": {"b": 2}}}')]
    assert got["bad.docx"][0][0] == "error" and got["n.txt"] == [("line", "")]
    pieces = S.split_json({"k" + str(i): "v" * 50 for i in range(40)}, 300)
    assert {k for p in pieces for k in p} == {"k" + str(i) for i in range(40)} and all(len(str(p)) < 400 for p in pieces)


def test_research_and_alignment(spark):
    start = spark.createDataFrame([("q", "a")], "query_id string, text string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "text string, chunk_id string")
    found = research(start, lambda q: q.join(links, "text"), lambda h: h.select("query_id", F.col("chunk_id").alias("text")))
    assert {(r.chunk_id, r["round"]) for r in found.collect()} == {("b", 0), ("c", 1), ("a", 2)}
    assert shortened_reasoning([str(i) for i in range(9)]) == ["0", "...", "5", "6", "7", "8"]
    chunks = spark.createDataFrame([("d", 0, "c0", "one two"), ("d", 1, "c1", "three"), ("d", 2, "c2", None)], "doc_id string, chunk_no int, chunk_id string, text string")
    blocks = spark.createDataFrame([("d", 0, "b0", "one"), ("d", 1, "b1", "two"), ("d", 2, "b2", "three")], "doc_id string, block_no int, block_id string, text string")
    assert {r.chunk_id: r.block_ids for r in align(chunks, blocks).collect()} == {"c0": ["b0", "b1"], "c1": ["b2"], "c2": []}


def test_written_tables_need_no_setting_on_a_local_session():
    """A fresh session without any configuration: the folder is chosen once, a given one is used instead."""
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as empty, tempfile.TemporaryDirectory() as given:
        code = (
            "from pyspark.sql import SparkSession\nfrom docloom import runtime as R\nimport os\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "a = R.materialize(s.range(3)); assert a.count() == 3 and R.shared_dir(s) == R.shared_dir(s)\n"
            f"R.shared_dir(s, 'file://{given}'); b = R.materialize(s.range(4)); assert b.count() == 4 and os.listdir('{given}')\n"
            "R.release(a); R.release(b); s.stop()\n"
        )
        env = {**os.environ, "SPARK_CONF_DIR": empty, "PYTHONPATH": root}
        subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=root)


def test_broadcasts_only_of_proven_sizes(spark, tmp_path):
    from docloom import runtime as R

    rows = R.materialize(spark.range(100).selectExpr("id", "array(1, 2) as a"))
    assert R.bounded(rows) and R.bounded(rows.groupBy("id").count()) and R.bounded(rows.where("id > 3").select("id"))
    assert not R.bounded(rows.selectExpr("explode(a)")) and not R.bounded(rows.join(rows, "id"))
    assert not R.bounded(rows.select("id").mapInArrow(lambda b: b, "id long"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(R.small(rows)) and not hinted(R.small(rows, 10)) and not hinted(R.small(rows.selectExpr("explode(a)")))


def test_written_postings_answer_like_those_of_one_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red valve opens red"), (2, "blue valve"), (3, ""), (4, None), (5, "green line red")], "doc_id int, text string")
    terms = R.query_terms(spark.createDataFrame([(9, "red valve nothing")], "q int, text string"), "q", "text")
    R.save_postings(docs, "doc_id", "text", str(tmp_path / "ix"), 8)
    a, n = R.indexed(docs, "doc_id", "text", terms)
    b, m = R.load_postings(spark, str(tmp_path / "ix"), terms)
    key = lambda df: sorted((r.doc_id, r.term, r.tf, r.length) for r in df.collect())
    assert key(a) == key(b) == [(1, "red", 2, 4), (1, "valve", 1, 4), (2, "valve", 1, 2), (5, "red", 1, 3)]
    assert n.collect() == m.collect() and n.first().n_docs == 3 and n.first().mean_length == 3.0
    whole = {(r.query_id, r.doc_id): round(r.score, 9) for r in R.bm25_scores(terms, R.postings(docs, "doc_id", "text")).collect()}
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in R.bm25_scores(terms, b, m).collect()} == whole


def test_cells_find_nine_in_ten(spark):
    import random

    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in centres[i % 15]]) for i in range(900)] + [(900, [0.0] * 12), (901, None), (None, [1.0] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = vectors.where("vec_id % 30 = 0").selectExpr("vec_id as query_id", "embedding")
    index = R.CellIndex(vectors, cells=20)
    assert index.vectors.count() == 900 and len(index.centres) == 20
    probes = index.probes_for(asked.where("query_id % 60 = 0"), 5)
    want = {(r.query_id, r.vec_id) for r in R.knn(asked, vectors, 5).collect()}
    got = {(r.query_id, r.vec_id) for r in index.search(asked, 5, probes).collect()}
    assert probes < 20 and len(got & want) >= 0.9 * len(want)
    none = R.CellIndex(vectors.where("vec_id = 900"))
    assert none.search(asked, 5).count() == 0


def test_rows_are_numbered_by_many_tasks(spark):
    from docloom.operators import tabular
    from docloom.runtime import numbered

    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int")
    assert [(r.k, r.n) for r in numbered(df, "k", name="n").orderBy("k").collect()] == [(i, i + 1) for i in range(101)]
    blocks = tabular.html_blocks(df, "k", 50, "k")
    assert sorted((r.block, r.html.count("<tr>") - 1) for r in blocks.collect()) == [(0, 50), (1, 50), (2, 1)]
    assert numbered(df.where("false"), "k").count() == 0


def test_epochs_replace_themselves(spark, tmp_path):
    from docloom.streaming import ingest

    batch = lambda *r: spark.createDataFrame(list(r), "k string, v int, x string")
    write = ingest.upsert_into(str(tmp_path / "t"), "k", "v")
    write(batch(("a", 1, "x"), ("b", 1, "x")), 0)
    write(batch(("a", 2, "y"), ("a", 3, "z"), ("b", 0, "old")), 1)
    write(batch(("a", 2, "y"), ("a", 3, "z"), ("b", 0, "old")), 1)
    want = {("a", 3, "z"), ("b", 1, "x")}
    assert {tuple(r) for r in ingest.upserted(spark, str(tmp_path / "t"), "k", "v").collect()} == want
    ingest.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"), "k", "v")
    assert {tuple(r) for r in ingest.upserted(spark, str(tmp_path / "u"), "k", "v").collect()} == want


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    from docloom.plans import flows

    rows = [(f"l{i % 7}", i, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(20)]
    spark.createDataFrame(rows, "link_id string, file_id bigint, document_id bigint, create_time timestamp").repartition(files).write.parquet(str(tmp_path / "raw"))
    parts = sorted((tmp_path / "raw").glob("*.parquet"))
    assert len(parts) == files
    if files == 1:
        parts[0].rename(tmp_path / "file2document.parquet")
    else:
        (tmp_path / "raw").rename(tmp_path / "file2document.parquet")
    (tmp_path / "file2document_old.parquet").mkdir()
    spark.createDataFrame([("other", 1, 1, dt.datetime(2030, 1, 1))], "link_id string, file_id bigint, document_id bigint, create_time timestamp").write.mode("overwrite").parquet(str(tmp_path / "file2document_old.parquet"))
    assert {tuple(r) for r in flows.stream_dedup_upsert(spark, str(tmp_path)).collect()} == {(f"l{k}", max(r[3] for r in rows if r[0] == f"l{k}")) for k in range(7)}
