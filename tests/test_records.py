"""Small cases of the records around documents: nulls, ties, empty tables, injected models, catalog tables and files."""

import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import records as R

T = lambda h: dt.datetime(2024, 1, 1, h)


def test_tasks_are_handed_out_until_done(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "task_id string")
    events = spark.createDataFrame([("a", "taken", T(1)), ("a", "taken", T(5)), ("b", "taken", T(1)), ("b", "done", T(2)), ("c", "cancelled", T(1)), ("e", "taken", T(1))], "task_id string, kind string, at timestamp")
    at = lambda h: {(r.task_id, r.delivery) for r in R.pending(tasks, events, F.lit(T(h)), 3600).collect()}
    assert at(5) == {("d", 1)} and at(6) == {("a", 3), ("d", 1)}
    assert R.pending(tasks.where("false"), events, F.lit(T(6)), 1).count() == 0


def test_entries_expire_and_are_removed(spark):
    rows = spark.createDataFrame([("u", T(1), 1), ("u", T(3), 2), ("v", T(3), 3), ("w", None, 4)], "k string, at timestamp, v int")
    gone = spark.createDataFrame([("v", T(4))], "k string, at timestamp")
    assert {(r.k, r.v) for r in R.unexpired(rows, "k", "at", F.lit(T(4)), 7200, gone).collect()} == {("u", 2)}
    assert {(r.k, r.v) for r in R.unexpired(rows, "k", "at", F.lit(T(4)), 7200).collect()} == {("u", 2), ("v", 3)}


def test_grants_fields_and_lookups(spark):
    old = spark.createDataFrame([("u", "r", 1, "read"), ("v", "r", 5, "read")], "who string, what string, version int, p string")
    new = spark.createDataFrame([("u", "r", 1, "write"), ("v", "r", 2, "write"), ("x", None, None, "admin")], old.schema)
    assert {(r.who, r.p) for r in R.granted(old, new, ["who", "what"], "version").collect()} == {("u", "write"), ("v", "read"), ("x", "admin")}
    conf = spark.createDataFrame([("k", '{"a": "1", "b": "2"}', 1), ("k", '{"a": "3"}', 2), ("k", "no json", 3), (None, "{}", 1), ("l", None, 1)], "k string, c string, v int")
    assert {(r.field, r.value) for r in R.field_maps(conf, "k", "c", "v").collect()} == {("a", "3"), ("b", "2")}
    nodes = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("c", "u", None)], "name string, type string, rank double")
    assert {(r.name, r.place) for r in G.entities_by_type(nodes, 1).collect()} == {("a", 1), ("c", 1)}
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "z", 1.0), ("y", "z", 1.0)], "src string, dst string, weight double")
    assert {(r.src, r.dst, r.both_ends) for r in G.relations_of(edges, nodes).collect()} == {("a", "b", True), ("b", "z", False)}


def test_reports_and_rebuilding(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "node string, level0 string")
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0), ("c", "d", 9.0)], "src string, dst string, weight double")
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 1)], "node string, rank int")
    got = G.community_reports(members, edges, ranks, lambda e, r: F.concat(e, F.lit("|"), r)).collect()
    assert [(r.community, r["size"], r.n_edges, r.report) for r in got] == [("a", 3, 2, "b,2\nc,2\na,1|b,c,3.0\na,b,2.0")]
    n = spark.createDataFrame([("a", "t", "x", "s1"), ("a", "t", "y", "s2"), ("b", "t", "z", "s2")], "name string, type string, description string, source_id string")
    e = spark.createDataFrame([("a", "b", 1.0, "q", "s2"), ("a", "c", 1.0, "q", "s1")], "src string, dst string, weight double, description string, source_id string")
    nodes, kept = G.rebuilt(n, e, spark.createDataFrame([("s2",)], "source_id string"))
    assert [(r.name, r.description) for r in nodes.collect()] == [("a", "x")] and [(r.src, r.dst) for r in kept.collect()] == [("a", "c")]


def test_injected_models_and_pages(spark):
    rows = spark.createDataFrame([("q", "aa", 0.5, None), ("q", None, None, 0.1)], "query string, text string, tokensim double, feature double")
    assert [round(r.score, 6) for r in R.with_model_scores(rows, lambda q, t: F.length(t) / 2).collect()] == [0.65, 0.07]
    tagged = spark.createDataFrame([(["x"], "a"), ([], "b"), (None, "c")], "tag_kwd array<string>, text string")
    assert [r.tag_kwd for r in R.with_fallback_tags(tagged, lambda t: F.array(t)).collect()] == [["x"], ["b"], ["c"]]
    chunks = spark.createDataFrame([("1", [1, 2], "The valve opens. Other words"), ("2", [2], "nothing"), ("3", [3], "valve"), ("4", None, "valve")], "id string, page_num_int array<int>, text string")
    assert {r.id: r.preview for r in R.preview(chunks, 2, "text", ["valve"]).collect()} == {"1": "The <em>valve</em> opens", "2": "nothing"}


def test_catalog_tables_and_benchmark_files(spark, tmp_path):
    spark.sql(f"create database if not exists bench location '{tmp_path}/db'")
    ix = R.Index(spark, "bench.chunks")
    ix.drop()
    assert not ix.exists() and ix.create("id string, kb string", ("kb",)) and not ix.create("id string") and ix.exists()
    assert ix.migrate({"id": "string", "tag": "string"}) == ["tag"] and ix.migrate({"tag": "string"}) == [] and spark.table("bench.chunks").columns == ["id", "tag", "kb"]
    ix.drop()
    spark.sql("drop database bench cascade")
    (tmp_path / "q.tsv").write_text("q1\t0\td1\t1\nq1\t0\td2\t0\n")
    qrels = R.read_qrels(spark, str(tmp_path / "q.tsv"))
    run = spark.createDataFrame([("q1", "d1", 0.5)], "query_id string, doc_id string, score double")
    R.write_report(spark.createDataFrame([("q1", 1.0)], "query_id string, ndcg double"), run, qrels, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "qrels")).first().docs.d1 == 1
    questions = spark.createDataFrame([("q", ["Valve", None], [("d1", "a valve"), ("d2", None)])], "question_id string, aliases array<string>, passages array<struct<doc_id string, text string>>")
    docs, rel = R.trivia_passages(questions)
    assert docs.count() == 2 and {(r.doc_id, r.relevance) for r in rel.collect()} == {("d1", 1), ("d2", 0)}
