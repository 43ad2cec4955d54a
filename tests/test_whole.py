"""Queries over their whole input; fixtures hold what the tables lack."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_queries import DATA, QUERIES, SQL, duck, rows  # noqa: F401

from docloom.functions import lexical as L
from docloom.operators import graph as G
from docloom.operators import retrieval as R
from docloom.operators import tabular as T

@pytest.mark.parametrize("name", ("graph_leiden", "community_overlap", "kg_walks"))
def test_graph_queries_without_sql_reach_all_nodes(spark, duck, name):  # noqa: F811
    nodes = {r[0] for r in duck.execute("select distinct a.l_partkey from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey").fetchall()}
    got = QUERIES[name](spark, DATA).toPandas()
    if name == "community_overlap":
        members = QUERIES["graph_leiden"](spark, DATA).toPandas().groupby("level0").size()
        assert dict(zip(got.community, got["size"])) == {k: n for k, n in members.items() if n >= 2}
    else:
        assert set(got.node) == nodes


def test_shared_pairs_of_groups_of_any_size(spark):
    random.seed(4)
    groups = {1: range(50), 2: range(40, 53), 3: [7], 4: [8, 8, 9], 5: random.sample(range(90), 31)}
    want: dict = {}
    for items in groups.values():
        for p in itertools.combinations(sorted(set(items)), 2):
            want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame([(g, i) for g, items in groups.items() for i in items] + [(None, 1), (None, 2), (1, None)], "g int, i int")
    for block in (4, 512):
        got = G.shared_pairs(df, "g", "i", block).collect()
        assert len(got) == len(want) and {(r.src, r.dst): r.weight for r in got} == want


def test_two_hop_scores_equal_the_listed_paths(spark):
    random.seed(6)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in itertools.combinations(range(40), 2) if random.random() < 0.05], "src int, dst int, weight double")
    starts = spark.createDataFrame([(n, 1.0 / (n + 2)) for n in (3, 8, 9, 21, 77)], "name int, similarity double")
    want = {(r.src, r.dst): round(r.score, 9) for r in G.path_scores(starts, G.paths_from(starts, edges, 2)).collect()}
    assert len(want) > 9 and {(r.src, r.dst): round(r.score, 9) for r in G.two_hop_scores(starts, edges).collect()} == want


def test_token_similarity_in_blocks_equals_the_join(spark):
    random.seed(8)
    word = lambda: f"w{min(random.randrange(60), random.randrange(60))}"
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(random.randrange(30)))) for i in range(70)], "id long, text string")
    index, terms = R.postings(texts, "id", "text"), R.query_terms(texts.where("id < 25"), "id", "text")
    want = {(r.query_id, r.doc_id): round(r.similarity, 7) for r in R.token_similarity(terms, index).collect() if r.similarity >= 0.3}
    for queries, size in ((128, 20_000), (3, 20)):
        got = R.token_similarity_from(terms, index, 0.3, None, queries, size).collect()
        assert len(got) == len(want) > 50 and {(r.query_id, r.doc_id): round(r.similarity, 7) for r in got} == want
        got = {(r.query_id, r.doc_id): round(r.similarity, 7) for r in R.token_similarity_from(terms, index, 0.3, 4, queries, size).collect()}
        assert got.items() <= want.items()
        for i in range(25):
            mine, all_ = (sorted((-s, d) for (q, d), s in x.items() if q == i) for x in (got, want))
            assert mine[:4] == all_[:4]
    pairs = texts.where("id < 25").selectExpr("id as query_id").crossJoin(texts.selectExpr("id as doc_id"))
    assert {(r.query_id, r.doc_id): round(r.similarity, 7) for r in R.token_similarity_of(pairs, terms, index).collect() if r.similarity >= 0.3} == want


def greedy(boxes, most=0.2):
    """Brute force: boxes as (page, kind, id, x0, x1, top, bottom, score)."""
    kept: list = []
    for b in sorted((b for b in boxes if b[7] > 0), key=lambda b: (-b[7], b[2])):
        for k in (k for k in kept if k[:2] == b[:2]):
            both = max(0, min(b[4], k[4]) - max(b[3], k[3])) * max(0, min(b[6], k[6]) - max(b[5], k[5]))
            union = (b[4] - b[3]) * (b[6] - b[5]) + (k[4] - k[3]) * (k[6] - k[5]) - both
            if union > 0 and both / union >= most:
                break
        else:
            kept.append(b)
    return sorted(k[2] for k in kept)


@pytest.mark.parametrize("local", (0, 40, 200_000))
def test_suppression_is_greedy(spark, local):
    random.seed(11)
    boxes = []
    for i in range(300):
        x, y = random.randrange(0, 300, 10), random.randrange(-50, 90, 10)
        boxes.append((random.choice((1, 2, None)), random.choice("ab"), f"b{i}", float(x), float(x + random.choice((0, 40, 60, 200))), float(y), float(y + random.choice((-5, 30, 40))), float(random.randrange(0, 60))))
    df = spark.createDataFrame(boxes, "page int, kind string, box_id string, x0 double, x1 double, top double, bottom double, score double")
    assert sorted(r.box_id for r in T.non_max(df, local=local).collect()) == greedy(boxes)


def test_box_non_max_takes_all_rows(spark, duck):  # noqa: F811
    boxes = duck.execute("select l_suppkey % 10, l_returnflag, concat_ws('-', l_orderkey, l_linenumber, l_partkey), l_quantity * 10, l_quantity * 10 + 40, l_tax * 500, l_tax * 500 + 30, l_extendedprice from lineitem").fetchall()
    boxes = list({b[2]: b for b in boxes}.values())
    assert sorted(QUERIES["box_non_max"](spark, DATA).toPandas().box_id) == greedy(boxes)


def test_resolution_pairs_are_complete(spark):
    random.seed(12)
    names = {"ABCD", "AXCX", "XBYD", "A", "AB", "数据平台", "数据台平", "平台数据库", "аб", "баа", "abé", "éba"}
    names |= {"".join(random.choice("ABC1é") for _ in range(random.randrange(1, 9))) for _ in range(60)} | {"".join(random.choice("ABCDE ") for _ in range(random.randrange(1, 9))) for _ in range(60)}
    nodes = spark.createDataFrame([(n, t) for n in names for t in ("x", "y") if t == "x" or len(n) % 2], "name string, type string")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    want = {(r.a, r.b) for r in pairs.where(G.similar_names(pairs.a, pairs.b)).collect()}
    assert ("ABCD", "AXCX") in want
    for block in (7, 512):
        got = [(r.a, r.b) for r in G.resolution_pairs(nodes, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_resolution_merge_moves_real_edges(spark, duck):  # noqa: F811
    at = {r[0]: r[0] for r in duck.execute("select distinct upper(p_name) from part").fetchall()}
    for a, b in duck.execute(SQL["entity_resolution_pairs"]).fetchall():
        x, y = sorted((at[a], at[b]))
        at = {k: x if v == y else v for k, v in at.items()}
    want = dict.fromkeys(at.values(), 0.0)
    for a, b in duck.execute("with n as (select distinct l_orderkey as o, upper(p_name) as n from lineitem join part on l_partkey = p_partkey) select a.n, b.n from n a join n b on a.o = b.o and a.n < b.n").fetchall():
        if at[a] != at[b]:
            want[at[a]] += 1
            want[at[b]] += 1
    got = QUERIES["entity_resolution_merge"](spark, DATA).toPandas()
    assert dict(zip(got.name, got.strength)) == want and sum(want.values()) > 0


def test_few_rows_leave_the_blocks_of_token_similarity(spark):
    n, k = 10_240, 50
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one task sees all blocks
    index = spark.range(1, n).selectExpr(f"{n} - id as doc_id", "explode(filter(sequence(0, 13), b -> shiftright(id, b) % 2 = 1)) as term").selectExpr("doc_id", "cast(term as string) as term")
    terms = spark.createDataFrame([(7, str(b), 2.0**b / 2**14) for b in range(14)], "query_id long, term string, weight double")
    try:
        got = sorted(((r.similarity, r.doc_id) for r in R.token_similarity_from(terms, index, 0.3, k).collect()), reverse=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert [d for _, d in got[:k]] == list(range(1, k + 1)) and all(abs(s - (n - d) / 2**14) < 1e-8 for s, d in got)
    assert len(got) < 4 * k


def cited(sentences, chunks):
    """Citations of one answer from its sentences and chunks, {number: set of terms}."""
    like = {(s, c): len(a & b) / len(a) for s, a in sentences.items() for c, b in chunks.items() if a & b}
    cut = next((x for x in (0.63, 0.63 * 0.8, 0.63 * 0.8 * 0.8, 0.63 * 0.8 * 0.8 * 0.8) if x <= max(like.values(), default=0)), 2)
    best = {s: max(v for (t, _), v in like.items() if t == s) for s, _ in like}
    rows = []
    for s in best:
        rows += sorted((-v, c, s) for (t, c), v in like.items() if t == s and v >= cut and v >= 0.99 * best[s])[:4]
    first = {}
    for v, c, s in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        first.setdefault(c, (s, c, round(-v, 9)))
    return set(first.values())


def test_citations_equal_brute_force(spark):
    random.seed(12)
    terms = lambda: {f"t{random.randrange(14)}" for _ in range(random.randrange(7))}
    answers = {a: ({n: terms() for n in range(random.randrange(9))}, {n: terms() for n in range(random.randrange(40))}) for a in range(60)}
    frame = lambda k, name: spark.createDataFrame([(a, n, [*t, *t]) for a, x in answers.items() for n, t in x[k].items()] + [(None, 1, ["t1"]), (1, None, ["t1"]), (2, 77, None)], f"answer_id long, {name} int, terms array<string>")
    want = {(a, *r) for a, x in answers.items() for r in cited(*x)}
    for at_once in (5, 1 << 17):
        out = R.citations(frame(0, "sentence_no"), frame(1, "chunk_id"), at_once=at_once)
        got = [(r.answer_id, r.sentence_no, r.chunk_id, round(r.similarity, 9)) for r in out.collect()]
        assert dict(out.dtypes)["chunk_id"] == "int" and len(got) == len(want) > 99 and set(got) == want
    # a null is a term that is met nowhere
    one = lambda name, t: spark.createDataFrame([("x", 3, t)], f"answer_id string, {name} long, terms array<string>")
    assert [tuple(r) for r in R.citations(one("sentence_no", ["a", None]), one("chunk_id", [None, "a"])).collect()] == [("x", 3, 3, 0.5)]


def test_text_citations_equal_those_of_pieces(spark):
    random.seed(13)
    marks = [". ", ".", "\n\n", "\n", "\n\n\n\n", ". \n\n", " ", " ", "．　", "。", "Σ. ", "... ", "ＡB", "ab", "Word", "word_2", "数据", "é", "x1", "pumpe"]
    texts = [(i, "".join(random.choice(marks) for _ in range(random.randrange(1, 90)))) for i in range(120)] + [(900, ""), (901, None), (None, "word one. word one"), (902, "\n\n"), (903, "a. b"), (904, "word one. Word one\n\nword two")]
    docs = spark.createDataFrame(texts, "id long, text string").where("text is not null and id is not null")
    split = lambda mark, name: docs.select(F.col("id").alias("answer_id"), F.posexplode(F.split("text", mark)).alias(name, "s"))
    frames = [x.select(x.columns[0], x.columns[1], L.tokens("s").alias("terms")) for x in (split(r"\. ", "sentence_no").where("length(s) >= 5"), split("\n\n", "chunk_id"))]
    sides = [{}, {}]
    for side, frame in zip(sides, frames):
        for a, n, t in frame.collect():
            side.setdefault(a, {})[n] = set(t)
    want = {(a, *r) for a in sides[0] for r in cited(sides[0][a], sides[1][a])}
    all_texts = spark.createDataFrame(texts, "id long, text string")
    for at_once in (5, 1 << 17):
        got = [(*r[:3], round(r[3], 9)) for r in R.text_citations(all_texts, "id", "text", at_once=at_once).collect()]
        assert len(got) == len(want) > 100 and set(got) == want
        assert {(*r[:3], round(r[3], 9)) for r in R.citations(*frames, at_once=at_once).collect()} == want


def test_citation_assign_joins_nothing(spark):
    """Sizes of exploded terms are underestimated: joined, they reach the driver as a broadcast, and a row per term is shuffled and sorted."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = QUERIES["citation_assign"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Broadcast", "Join", "Generate", "Window"))
