"""Graph, tag and text-to-SQL queries. The graph links parts that were ordered together."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.operators import graph as G
from docloom.operators import nlsql, tags
from docloom.operators import retrieval as R
from docloom.plans.lexical import TOKENS
from docloom.runtime import materialize, table


def _edges(spark, sf_dir):
    """(src, dst, weight): parts of one order, by orders shared."""
    return G.shared_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def graph_parse_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('("entity"<|>Customer '), F.col("o_custkey").cast("string"), F.lit("<|>client<|>orders "), "o_orderpriority", F.lit(')##("relationship"<|>Customer '), F.col("o_custkey").cast("string"), F.lit("<|>Status "), "o_orderstatus", F.lit("<|>places<|>order<|>"), F.round("o_totalprice").cast("bigint").cast("string"), F.lit(")##(broken")).alias("text"))
    _, rel = G.parse_records(o, "text", "o_orderkey")
    return rel.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def graph_merge_nodes(spark, sf_dir):
    ent = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("source_id"))
    return G.merge_nodes(ent).select("name", "type", "description", F.size("source_id").cast("bigint").alias("n_sources"))


def graph_merge_edges(spark, sf_dir):
    rel = table(spark, sf_dir, "lineitem").select(F.least(F.col("l_partkey"), F.col("l_suppkey") + 0).alias("src"), F.greatest(F.col("l_partkey"), F.col("l_suppkey") + 0).alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("description"), F.col("l_orderkey").alias("source_id"))
    return G.merge_edges(rel).select("src", "dst", F.round("weight", 4).alias("weight"), "description", F.size("source_id").cast("bigint").alias("n_sources"))


def graph_degree_rank(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir)).select("node", "degree", F.round("strength", 6).alias("strength"))


def graph_endpoint_semi(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("name"))
    return G.with_endpoints(_edges(spark, sf_dir), nodes).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def graph_pagerank_k(spark, sf_dir):
    return G.pagerank(_edges(spark, sf_dir), rounds=3).select("node", F.round("rank", 9).alias("rank"))


def graph_connected_components(spark, sf_dir):
    return G.components(_edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))


def graph_largest_component(spark, sf_dir):
    return G.largest_component(_edges(spark, sf_dir)).agg(F.count("*").alias("n_edges"))


def graph_leiden(spark, sf_dir):
    return G.communities(_edges(spark, sf_dir), rounds=4)


def community_overlap(spark, sf_dir):
    """Communities that hold any of the wanted nodes, here of all nodes, heaviest first."""
    e = _edges(spark, sf_dir)
    members = materialize(G.communities(e, rounds=4))
    ranks = G.degrees(e).select("node", F.col("strength").alias("rank"))
    w = G.community_weights(members, ranks)
    wanted = members.select(F.col("level0").alias("community")).distinct()
    return w.join(wanted, "community", "left_semi").select("community", F.round("weight", 6).alias("weight"), "size")


def entity_resolution_pairs(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.upper("p_name").alias("name"), F.col("p_type").alias("type")).distinct()
    return G.resolution_pairs(nodes)


def entity_resolution_merge(spark, sf_dir):
    """Names after merging: nodes of each, and its links to other names, by orders shared."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), F.col("p_type").alias("type"))
    nodes = part.select("name", "type").distinct()
    ordered = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    merged, edges = G.merge_resolved(nodes, G.shared_pairs(ordered, "l_orderkey", "name"), G.resolution_pairs(nodes))
    links = G.degrees(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))).withColumnRenamed("node", "name")
    return merged.groupBy("name").agg(F.count("*").alias("n")).join(links, "name", "left").select("name", "n", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def kg_top_view(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ranks = G.degrees(e).select("node", F.col("strength").alias("rank"))
    return G.top_view(ranks, e).select("src", "dst", "weight")


def kg_nhop_score(spark, sf_dir):
    e = _edges(spark, sf_dir)
    starts = G.both_ways(e).select(F.col("src").alias("name")).distinct()
    return G.two_hop_scores(starts.withColumn("similarity", 1.0 / (1 + F.col("name"))), e).select("src", "dst", F.round("score", 9).alias("score"))


def kg_walks(spark, sf_dir):
    return G.random_walks(_edges(spark, sf_dir), 3).select("node", F.size("walk").alias("length"))


def mindmap_labels(spark, sf_dir):
    return G.unique_labels(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "label")


def raptor_tree(spark, sf_dir):
    return G.cluster_tree(table(spark, sf_dir, "embeddings"), lambda v: v).select("layer", "node", "parent", "n_members")


def _tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lower(F.trim("lang")), F.lower(F.trim("source"))).alias("t"))
    return d


def tag_prior(spark, sf_dir):
    rows = _tags(spark, sf_dir).select(F.explode("t").alias("tag")).where("tag is not null")
    return tags.prior(rows).select("tag", F.round("prior", 9).alias("prior"))


def _tag_matches(spark, sf_dir):
    terms = materialize(R.query_terms(table(spark, sf_dir, "eval_items").where("item_id % 50 = 0"), "item_id", "text"))
    s = R.at_least(R.token_similarity(terms, R.postings(_tags(spark, sf_dir), "doc_id", "text", terms)), 0.3)
    return s.select("query_id", "doc_id").join(_tags(spark, sf_dir).select("doc_id", F.explode("t").alias("tag")).where("tag is not null"), "doc_id")


def tag_query_scores(spark, sf_dir):
    rows = _tags(spark, sf_dir).select(F.explode("t").alias("tag")).where("tag is not null")
    return tags.lift(_tag_matches(spark, sf_dir), tags.prior(rows, 1), ["query_id"], 1, floor=F.lit(1))


def tag_chunk_scores(spark, sf_dir):
    """Datasets (as tags) of the documents of one kind and language, by lift over the datasets' priors."""
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null and kb_id is not null")
    rows = d.select(F.concat_ws("/", F.lower(F.trim("source")), F.lower(F.trim("lang"))).alias("kind"), F.col("kb_id").alias("tag"))
    return tags.lift(rows, tags.prior(rows.select("tag"), 1), ["kind"], 1)


def _part_view(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), L.tokens("p_name").alias("name_tks"), F.col("p_brand").alias("brand_kwd"), F.col("p_size").alias("size_long"), F.col("p_retailprice").alias("price_flt"))
    p.createOrReplaceTempView("parts_typed")


def text2sql_aggregate(spark, sf_dir):
    _part_view(spark, sf_dir)
    return nlsql.ask(spark, "average price by brand", lambda q, e: "```sql\nSELECT brand_kwd, count(*) AS n, round(avg(price_flt), 4) AS price FROM parts_typed GROUP BY brand_kwd; drop table x\n```", "parts_typed")


def text2sql_token_match(spark, sf_dir):
    _part_view(spark, sf_dir)
    return nlsql.ask(spark, "red widgets", lambda q, e: "select size_long from parts_typed where name_tks like '%red widget%' and size_long > 10", "parts_typed")


def sql_script(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_v")
    return nlsql.as_json_rows(nlsql.statements(spark, "select 1; select o_orderstatus, count(*) as n from orders_v group by 1 order by 1;")[1])


QUERIES = {f.__name__: f for f in (graph_parse_records, graph_merge_nodes, graph_merge_edges, graph_degree_rank, graph_endpoint_semi, graph_pagerank_k, graph_connected_components, graph_largest_component, graph_leiden, community_overlap, entity_resolution_pairs, entity_resolution_merge, kg_top_view, kg_nhop_score, kg_walks, mindmap_labels, raptor_tree, tag_prior, tag_query_scores, tag_chunk_scores, text2sql_aggregate, text2sql_token_match, sql_script)}

_LI = "li as (select distinct l_orderkey, l_partkey as p from lineitem), e as materialized (select a.p as src, b.p as dst, count(*)::double as weight from li a join li b on a.l_orderkey = b.l_orderkey and a.p < b.p group by 1, 2)"
_B = "b as (select src, dst, weight from e union all select dst, src, weight from e)"


def _least_labels(edges: str, rounds: int = 10) -> str:
    """cc (node, component): smallest node within ``rounds`` steps, doubled each round by the label's own label; far beyond any diameter here."""
    out = f"c0 as materialized (select src as node, least(src, min(dst)) as component from {edges} group by 1)"
    for i in range(1, rounds):
        near = f"select c.node, least(any_value(c.component), min(x.component)) as component from c{i - 1} c join {edges} b on c.node = b.src join c{i - 1} x on b.dst = x.node group by 1"
        out += f", n{i} as materialized ({near}), c{i} as materialized (select n.node, least(n.component, j.component) as component from n{i} n join n{i} j on n.component = j.node)"
    return f"{out}, cc as (select * from c{rounds - 1})"


def _spread_labels(edges: str, name: str, rounds: int = 4) -> str:
    """{name}{rounds} (node, label): rounds of weighted label propagation, the own label counting half; ties to the smaller label."""
    out = f"{name}0 as materialized (select distinct src as node, src as label from {edges})"
    for i in range(1, rounds + 1):
        votes = f"select b.src as node, l.label, b.weight as w from {edges} b join {name}{i - 1} l on b.dst = l.node union all select node, label, 0.5 from {name}{i - 1}"
        out += f", {name}{i} as materialized (select node, label from (select node, label, row_number() over (partition by node order by round(sum(w), 6) desc, label) as rn from ({votes}) group by 1, 2) where rn = 1)"
    return out


_LEVELS = (
    f"{_spread_labels('b', 'f')}, big as (select node, label from f4 where label in (select label from f4 group by 1 having count(*) > 12)), "
    "inn as materialized (select src, dst, weight, x.label as a from b join big x on src = x.node join big y on dst = y.node where x.label = y.label), "
    f"ib as materialized (select src, dst, weight from inn join (select a, avg(weight) as m from inn group by 1) using (a) where weight >= m), {_spread_labels('ib', 's')}"
)
_SIM = "not coalesce(list_bool_or(list_transform(list_concat(list_filter(x, lambda p: not list_contains(y, p)), list_filter(y, lambda p: not list_contains(x, p))), lambda p: regexp_matches(p, '[0-9]'))), false) and levenshtein(a, b) <= floor(least(length(a), length(b)) / 2)"
_NP = "n as (select distinct upper(p_name) as name, p_type as type from part), q as (select name, type, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) as g from n), pr as (select distinct a, b from (select q1.name as a, q2.name as b, q1.g as x, q2.g as y from q q1 join q q2 on q1.type = q2.type and q1.name < q2.name) where " + _SIM + ")"
_PR3 = "o as (select src, sum(weight) as o from b group by 1), p as (select b.src, b.dst, weight / o as p from b join o on b.src = o.src), nn as (select count(*) as n from o), r0 as (select src as node, 1.0 / n as rank from o, nn)" + "".join(
    f", r{i} as (select dst as node, 0.15 / (select n from nn) + 0.85 * sum(p * rank) as rank from p join r{i - 1} on src = node group by 1)" for i in (1, 2, 3)
)
_TG = "tg as (select doc_id, unnest([lower(trim(lang)), lower(trim(source))]) as tag from documents), t1 as (select tag, count(*) as n from tg where tag is not null group by 1)"
from docloom.plans.retrieval import _IX, _SIM as _TSIM, _T  # noqa: E402

SQL = {
    "graph_parse_records": "select 'CUSTOMER ' || o_custkey as src, 'STATUS ' || o_orderstatus as dst, count(*) as n, sum(round(o_totalprice)) as weight from orders group by 1, 2",
    "graph_merge_nodes": "with t as (select o_custkey, o_orderstatus as type, row_number() over (partition by o_custkey order by count(*) desc, o_orderstatus) as rn from orders group by 1, 2), d as (select o_custkey, string_agg(o_orderpriority, '<SEP>' order by o_orderpriority) as description from (select distinct o_custkey, o_orderpriority from orders) group by 1), s as (select o_custkey, count(distinct o_orderkey) as n_sources from orders group by 1) select 'C' || o_custkey as name, type, description, n_sources from t join d using (o_custkey) join s using (o_custkey) where rn = 1",
    "graph_merge_edges": "with r as (select least(l_partkey, l_suppkey) as src, greatest(l_partkey, l_suppkey) as dst, l_quantity as w, l_returnflag as d, l_orderkey as s from lineitem where l_partkey <> l_suppkey), x as (select src, dst, string_agg(d, '<SEP>' order by d) as description from (select distinct src, dst, d from r) group by 1, 2) select src, dst, round(sum(w), 4) as weight, any_value(description) as description, count(distinct s) as n_sources from r join x using (src, dst) group by 1, 2",
    "graph_degree_rank": f"with {_LI}, {_B} select src as node, count(*) as degree, round(sum(weight), 6) as strength from b group by 1",
    "graph_endpoint_semi": f"with {_LI} select count(*) as n, sum(weight) as weight from e where src in (select p_partkey from part where p_size > 20) and dst in (select p_partkey from part where p_size > 20)",
    "graph_pagerank_k": f"with {_LI}, {_B}, {_PR3} select node, round(rank, 9) as rank from r3",
    "entity_resolution_pairs": f"with {_NP} select a, b from pr",
    "kg_top_view": f"with {_LI}, {_B}, k as (select src as node from b group by 1 order by sum(weight) desc, src limit 256) select src, dst, weight from e where src in (select node from k) and dst in (select node from k) order by weight desc, src, dst limit 128",
    "kg_nhop_score": f"with {_LI}, {_B}, p1 as (select src as name, dst as m from b), p2 as (select name, m, dst as z from p1 join b on b.src = m where dst <> name), h as (select name, m, 1 + k as n from p1 join (select src, count(*) - 1 as k from b group by 1) d on d.src = m), f as (select least(name, m) as src, greatest(name, m) as dst, n / (1.0 + name) / 2 as s from h union all select least(m, z), greatest(m, z), 1 / (1.0 + name) / 3 from p2) select src, dst, round(sum(s), 9) as score from f group by 1, 2",
    "mindmap_labels": "select p_partkey, case when n > 1 then p_name || '(' || n || ')' else p_name end as label from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part)",
    "tag_prior": f"with {_TG} select tag, round((n + 1) / ((select sum(n) from t1) + 1000), 9) as prior from t1",
    "tag_query_scores": f"with {_T}, {_IX}, {_TSIM}, {_TG}, m as (select query_id, tag from sim join tg using (doc_id) where n_hits >= greatest(1, floor(n_terms * 0.3)) and tag is not null), c as (select query_id, tag, count(*) as c from m group by 1, 2), k as (select query_id, sum(c) as cnt from c group by 1), x as (select query_id, tag, 0.1 * (c + 1) / (cnt + 1) / greatest(1e-6, (n + 1) / ((select sum(n) from t1) + 1)) as raw from c join k using (query_id) join t1 using (tag)) select query_id, replace(tag, '.', '_') as tag, greatest(1, round_even(raw, 0))::bigint as score from (select *, row_number() over (partition by query_id order by round(raw, 9) desc, tag) as rn from x) where rn <= 3",
    "tag_chunk_scores": "with r as (select lower(trim(source)) || '/' || lower(trim(lang)) as kind, kb_id as tag from documents where source is not null and lang is not null and kb_id is not null), t1 as (select tag, count(*) as n from r group by 1), c as (select kind, tag, count(*) as c from r group by 1, 2), k as (select kind, sum(c) as cnt from c group by 1), x as (select kind, tag, 0.1 * (c + 1) / (cnt + 1) / greatest(1e-6, (n + 1) / ((select sum(n) from t1) + 1)) as raw from c join k using (kind) join t1 using (tag)) select kind, replace(tag, '.', '_') as tag, round_even(raw, 0)::bigint as score from (select *, row_number() over (partition by kind order by round(raw, 9) desc, tag) as rn from x) where rn <= 3 and round_even(raw, 0) > 0",
    "graph_connected_components": f"with {_LI}, {_B}, {_least_labels('b')} select component, count(*) as size from cc group by 1",
    "graph_largest_component": f"with {_LI}, {_B}, {_least_labels('b')} select count(*) as n_edges from e where src in (select node from cc where component = (select component from cc group by 1 order by count(*) desc, component limit 1))",
    "graph_leiden": f"with {_LI}, {_B}, {_LEVELS} select f4.node, f4.label as level0, coalesce(s4.label, f4.label) as level1 from f4 left join s4 on f4.node = s4.node",
    "community_overlap": f"with {_LI}, {_B}, {_spread_labels('b', 'f')}, r as (select src as node, sum(weight) as rank from b group by 1), w as (select label as community, sum(rank) as w, count(*) as size from f4 join r using (node) group by 1 having count(*) >= 2) select community, round(w / (select max(w) from w), 6) as weight, size from w",
    "entity_resolution_merge": f"with {_NP}, bp as (select a as src, b as dst from pr union all select b, a from pr), {_least_labels('bp')}, nm as (select distinct upper(p_name) as name, p_type as type from part), pt as (select p_partkey, upper(p_name) as name from part), lo as (select distinct l_orderkey as o, name from lineitem join pt on l_partkey = p_partkey), ee as (select a.name as a, b.name as b, count(*)::double as w from lo a join lo b on a.o = b.o and a.name < b.name group by 1, 2), to_ as (select node, component from cc), me as (select least(coalesce(x.component, a), coalesce(y.component, b)) as src, greatest(coalesce(x.component, a), coalesce(y.component, b)) as dst, sum(w) as w from ee left join to_ x on a = x.node left join to_ y on b = y.node where coalesce(x.component, a) <> coalesce(y.component, b) group by 1, 2), dg as (select name, count(*) as degree, sum(w) as strength from (select src as name, w from me union all select dst, w from me) group by 1) select coalesce(component, nm.name) as name, count(*) as n, coalesce(any_value(degree), 0) as degree, coalesce(any_value(strength), 0.0) as strength from nm left join to_ on nm.name = node left join dg on dg.name = coalesce(component, nm.name) group by 1",
    "text2sql_aggregate": "select p_brand as brand_kwd, count(*) as n, round(avg(p_retailprice), 4) as price from part group by 1",
    "text2sql_token_match": "select p_partkey as doc_id, p_size as size_long from part where (contains(' ' || lower(p_name) || ' ', ' red ') or contains(' ' || lower(p_name) || ' ', ' widget ')) and p_size > 10",
    "sql_script": "select '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"n\":' || count(*) || '}' as json from orders group by o_orderstatus",
}
