"""Queries over the records around the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions.segment import with_frequency
from docloom.operators import graph as G
from docloom.operators import records as R
from docloom.plans.graph import _edges
from docloom.runtime import table


def stripped_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content_ltks"), F.col("lang").alias("q_768_vec"), "suffix")
    return R.without_indexed(rows)


def people_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return R.people(rows, {"c_name": "1", "c_mktsegment": "BUILD"}, [F.col("c_name").asc(), F.col("c_custkey").asc()], 2, 20).select("c_custkey", "c_name", "total")


def people_assignable(spark, sf_dir):
    return R.assignable(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def session_listing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = R.sessions(e, [F.col("ts").desc(), F.col("event_id").desc()], 1, 40, ("event_type", "c"), F.expr("timestamp '2024-01-01'"), None, "ts", ("props",))
    return out.select("event_id", "user_id", "total")


def page_then_time(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "created_at")
    return R.page_then_time(docs, [F.col("doc_id").asc()], 3, 50, F.expr("timestamp '2024-06-01'"), "created_at").select("doc_id")


def field_map_union(spark, sf_dir):
    d = table(spark, sf_dir, "kb_document").select("kb_id", "parser_config", F.struct("create_time", "document_id", "parser_config").alias("v"))
    return R.field_maps(d, "kb_id", "parser_config", "v")


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    users = c.select((F.col("c_custkey") % 50).alias("resource_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, "read").otherwise("write").alias("permission"))
    teams = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("resource_id"), F.col("s_nationkey").alias("team_id"), F.lit("read").alias("permission"))
    names = c.select(F.lit("user").alias("holder_kind"), F.col("c_custkey").cast("string").alias("holder_id"), F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.lit("team"), F.col("n_nationkey").cast("string"), "n_name").toDF("holder_kind", "holder_id", "name"))
    return users, teams, names


def permission_listing(spark, sf_dir):
    return R.grants(*_people(spark, sf_dir)).select("resource_id", "holder_kind", "holder_id", "name", "permission")


def grant_upsert(spark, sf_dir):
    """Orders as grants of a priority to a customer; the later half arrives."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("version"), "o_orderstatus")
    return R.granted(o.where("version % 2 = 0"), o.where("version % 2 = 1"), ["o_custkey", "o_orderpriority"], "version")


def chunk_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("id is not null").select("id", "page_num_int", F.col("content_with_weight").alias("text")).distinct()
    return R.preview(rows, 2, "text", ["pipeline", "valve"]).select("id", F.md5("preview").alias("preview_md5"))


def chunk_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "content_list").where("block_id is not null and document_id is not null").select("document_id", "block_no", "block_id").distinct()
    return R.sequence(rows, "document_id", F.col("block_no").asc_nulls_last(), F.col("block_id").asc(), most=8).select("document_id", "block_id", F.col("place").cast("bigint").alias("place"))


def queue_pending(spark, sf_dir):
    """Events as a queue: a user is a task, clicks take it, purchases finish it, errors cancel it."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "cancelled").otherwise("taken")
    part = e.where("event_id % 17 = user_id % 17")
    return R.pending(e.select(F.col("user_id").alias("task_id")), part.select(F.col("user_id").alias("task_id"), kind.alias("kind"), F.col("ts").alias("at")), F.expr("timestamp '2024-02-01'"), 3600)


def cache_unexpired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kept = R.unexpired(e.where("event_type <> 'error'").select("user_id", "ts", "event_id"), "user_id", "ts", F.expr("timestamp '2024-01-31'"), 5 * 86400, e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at")))
    return kept.select("user_id")


def model_rerank(spark, sf_dir):
    """The model here is the share of a text's length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("q").alias("query"), F.coalesce("text", F.lit("")).alias("text"), ((F.col("doc_id") % 10) / 10).alias("tokensim"), F.lit(None).cast("double").alias("feature"))
    return R.with_model_scores(d, lambda q, t: F.length(t) / 1000.0).select("doc_id", F.round("score", 6).alias("score"))


def fallback_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("id is not null").select("id", "tag_kwd", F.col("content_with_weight").alias("text")).distinct()
    return R.with_fallback_tags(rows, lambda t: F.array(F.concat(F.lit("len"), (F.length(t) % 3).cast("string")))).select("id", F.array_join("tag_kwd", "|").alias("tags"))


def trivia_relevance(spark, sf_dir):
    """Questions are the sources, with a word each as alias; passages the documents."""
    d = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    rows = d.groupBy(F.lower(F.trim("source")).alias("question_id")).agg(F.array(F.lit("Valve"), F.lit("")).alias("aliases"), F.collect_list(F.struct("doc_id", "text")).alias("passages"))
    _, qrels = R.trivia_passages(rows)
    return qrels.groupBy("query_id").agg(F.sum("relevance").alias("relevant"), F.count("*").alias("n"))


def community_reports(spark, sf_dir):
    """Material of the communities: entities and relations as text; the report is its size here."""
    e = _edges(spark, sf_dir)
    members = G.communities(e, rounds=4)
    return G.community_reports(members, e, G.degrees(e).select("node", F.col("degree").alias("rank")), lambda entities, relations: F.concat_ws("/", F.length(entities), F.length(relations))).select("community", "size", "n_edges", "report")


def graph_rebuilt(spark, sf_dir):
    """Subgraphs by order priority, put together without those of excluded documents."""
    o = table(spark, sf_dir, "orders")
    nodes = o.select(F.col("o_custkey").cast("string").alias("name"), F.lit("client").alias("type"), F.col("o_orderstatus").alias("description"), F.col("o_orderpriority").alias("source_id"))
    edges = o.select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.lit(1.0).alias("weight"), F.col("o_orderstatus").alias("description"), F.col("o_orderpriority").alias("source_id"))
    n, e = G.rebuilt(nodes, edges, o.where("o_orderpriority like '1%'").select(F.col("o_orderpriority").alias("source_id")).distinct())
    return n.select("name", F.size("source_id").cast("bigint").alias("n_sources"), F.lit(0.0).alias("weight")).unionByName(e.select(F.concat_ws("-", "src", "dst").alias("name"), F.size("source_id").cast("bigint").alias("n_sources"), "weight"))


def entity_lookup(spark, sf_dir):
    """Parts by type, the most expensive first."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("rank"))
    return G.entities_by_type(p, 5, tie="id").select("type", "id", "place")


def relation_lookup(spark, sf_dir):
    """Edges between wanted nodes."""
    wanted = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("name"))
    return G.relations_of(_edges(spark, sf_dir), wanted).groupBy("both_ends").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def vector_mix(spark, sf_dir):
    """Each vector mixed with the next one's, as that of its title."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("title"))
    mixed = v.join(t, "vec_id", "left").withColumn("m", R.mixed_vectors(F.col("title"), F.col("embedding")))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("m").alias("n"))


def embedding_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("id is not null").select("id", "question_kwd", F.coalesce("content_with_weight", F.lit("")).alias("text")).distinct()
    return rows.select("id", F.md5(R.embedding_input(F.col("question_kwd"), F.col("text"))).alias("text_md5"))


def chunks_enriched(spark, sf_dir):
    """The models here are the first word and the length."""
    rows = table(spark, sf_dir, "content_list").where("block_id is not null").select("block_id", "text").distinct()
    return R.enriched(rows, first=lambda t: F.split(t, " ")[0], size=lambda t: F.length(t)).select("block_id", "first", F.coalesce("size", F.lit(-1)).alias("size"))


def prompt_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", L.key_lines(name=F.col("c_name"), segment=F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), key=F.col("c_custkey")).alias("lines"))


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", L.message(F.col("c_custkey"), ["Hello {name}", "{name} of {segment}", "nobody"], name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("message"))


def term_frequencies(spark, sf_dir):
    """Words of the evaluation items with their documents and script as dictionary."""
    words = table(spark, sf_dir, "eval_items").select("item_id", F.explode(F.array_distinct(L.tokens("text"))).alias("term"))
    known = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(L.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("frequency")).where("frequency > 5").withColumn("tag", F.when(F.col("term").rlike("^[a-z]+$"), "latin").otherwise("other"))
    return with_frequency(words, known).groupBy("item_id", "tag").agg(F.sum("frequency").alias("total"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stripped_columns, people_listing, people_assignable, session_listing, page_then_time, field_map_union, permission_listing, grant_upsert, chunk_preview, chunk_sequence, queue_pending, cache_unexpired, model_rerank, fallback_tags, trivia_relevance, community_reports, graph_rebuilt, entity_lookup, relation_lookup, vector_mix, embedding_texts, chunks_enriched, prompt_lines, messages, term_frequencies)}

from docloom.plans.graph import _B, _LI, _spread_labels  # noqa: E402
from docloom.plans.lexical import TOKENS  # noqa: E402

SQL = {
    "stripped_columns": "select doc_id, suffix from documents",
    "people_listing": "with f as (select c_custkey, c_name from customer where contains(lower(c_name), '1') and contains(lower(c_mktsegment), 'build')) select c_custkey, c_name, (select count(*) from f) as total from f order by c_name, c_custkey limit 20 offset 20",
    "people_assignable": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority like '1%')",
    "session_listing": "with f as (select * from events where contains(lower(event_type), 'c') and ts >= timestamp '2024-01-01') select event_id, user_id, (select count(*) from f) as total from f order by ts desc, event_id desc limit 40",
    "page_then_time": "select doc_id from (select doc_id, created_at from documents order by doc_id limit 50 offset 100) where created_at >= timestamp '2024-06-01'",
    "permission_listing": "with b as (select c_custkey % 50 as resource_id, 'user' as holder_kind, c_custkey::varchar as holder_id, case when c_acctbal < 0 then 'read' else 'write' end as permission from customer union select s_suppkey % 50, 'team', s_nationkey::varchar, 'read' from supplier), n as (select 'user' as holder_kind, c_custkey::varchar as holder_id, c_name as name from customer union all select 'team', n_nationkey::varchar, n_name from nation where n_nationkey < 20) select resource_id, holder_kind, holder_id, name, permission from b left join n using (holder_kind, holder_id)",
    "grant_upsert": "select o_custkey, o_orderpriority, o_orderkey as version, o_orderstatus from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc) as rn from orders) where rn = 1",
    "chunk_preview": r"with r as (select distinct id, page_num_int, content_with_weight as text from chunk_app where id is not null), s as (select id, text, list_filter(list_transform(regexp_split_to_array(text, '[.?!;\n]'), lambda x: regexp_replace(x, '(?i)(^|[ .,;:!?()])(pipeline|valve)($|[ .,;:!?()])', '\1<em>\2</em>\3', 'g')), lambda x: contains(x, '<em>')) as p from r where list_contains(page_num_int, 2)) select id, md5(case when len(p) > 0 then array_to_string(list_transform(p, lambda x: trim(x)), '...') else text end) as preview_md5 from s",
    "chunk_sequence": "with d as (select distinct document_id, block_no, block_id from content_list where block_id is not null and document_id is not null), r as (select *, row_number() over (partition by document_id order by block_no nulls last, block_id) as place from d) select document_id, block_id, place from r where place <= 8",
    "queue_pending": "with p as (select user_id as task_id, case event_type when 'purchase' then 'done' when 'error' then 'cancelled' else 'taken' end as kind, ts from events where event_id % 17 = user_id % 17), a as (select task_id, max(case when kind = 'taken' then ts end) as t, sum((kind = 'taken')::int) as n, bool_or(kind <> 'taken') as x from p group by 1) select u.task_id, coalesce(n, 0)::bigint + 1 as delivery from (select distinct user_id as task_id from events) u left join a using (task_id) where not coalesce(x, false) and (t is null or floor(epoch(timestamp '2024-02-01')) - floor(epoch(t)) >= 3600)",
    "cache_unexpired": "with l as (select user_id, max(ts) as ts from events where event_type <> 'error' group by 1), g as (select user_id, max(ts) as gone from events where event_type = 'error' group by 1) select user_id from l left join g using (user_id) where floor(epoch(timestamp '2024-01-31')) - floor(epoch(ts)) < 432000 and (gone is null or ts > gone)",
    "model_rerank": "select doc_id, round(0.7 * ((doc_id % 10) / 10) + 0.3 * (length(coalesce(text, '')) / 1000.0), 6) as score from documents",
    "fallback_tags": "with r as (select distinct id, tag_kwd, content_with_weight as text from chunk_app where id is not null) select id, case when len(coalesce(tag_kwd, [])) > 0 then array_to_string(tag_kwd, '|') else coalesce('len' || (length(text) % 3), '') end as tags from r",
    "trivia_relevance": "select lower(trim(source)) as query_id, sum(contains(lower(text), 'valve')::int)::bigint as relevant, count(*) as n from documents where source is not null and text is not null group by 1",
    "community_reports": f"with {_LI}, {_B}, {_spread_labels('b', 'f')}, dg as (select src as node, count(*) as rank from b group by 1), n as (select label as community, count(*) as size, sum(length(f4.node::varchar) + 1 + length(rank::varchar)) + count(*) - 1 as a from f4 join dg using (node) group by 1 having count(*) >= 2), r as (select x.label as community, count(*) as n_edges, row_number() over () as z, sum(1) as s from e join f4 x on src = x.node join f4 y on dst = y.node and x.label = y.label group by 1), k as (select x.label as community, length(src::varchar) + length(dst::varchar) + 2 + length(weight::varchar) as l, row_number() over (partition by x.label order by weight desc, src, dst) as rn from e join f4 x on src = x.node join f4 y on dst = y.node and x.label = y.label), kl as (select community, sum(l) + count(*) - 1 as b from k where rn <= 10000 group by 1) select n.community, size, coalesce(n_edges, 0)::bigint as n_edges, a::bigint || '/' || coalesce(b, 0)::bigint as report from n left join r using (community) left join kl using (community)",
    "graph_rebuilt": "with o as (select * from orders where o_orderpriority not like '1%') select o_custkey::varchar as name, count(distinct o_orderpriority) as n_sources, 0.0 as weight from o group by 1 union all select o_custkey || '-s' || o_orderstatus, count(distinct o_orderpriority), count(*)::double from o group by 1",
    "entity_lookup": "select type, id, place from (select p_type as type, p_partkey as id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from part) where place <= 5",
    "relation_lookup": f"with {_LI}, w as (select p_partkey as k from part where p_size < 10), j as (select weight, (src in (select k from w))::int + (dst in (select k from w))::int as c from e) select c = 2 as both_ends, count(*) as n, sum(weight) as weight from j where c > 0 group by 1",
    "vector_mix": "with v as (select vec_id, embedding::double[] as e from embeddings), m as (select a.vec_id, case when b.e is null then a.e else list_transform(range(1, len(a.e) + 1), lambda i: 0.1 * b.e[i] + 0.9 * a.e[i]) end as m from v a left join v b on b.vec_id = a.vec_id + 1) select vec_id, round(list_sum(m), 6) as total, len(m)::int as n from m",
    "embedding_texts": "with r as (select distinct id, question_kwd, coalesce(content_with_weight, '') as text from chunk_app where id is not null), s as (select id, text, list_filter(coalesce(question_kwd, []), lambda q: trim(q) <> '') as q from r) select id, md5(case when len(q) > 0 then array_to_string(q, chr(10)) else text end) as text_md5 from s",
    "chunks_enriched": "select distinct block_id, string_split(text, ' ')[1] as first, coalesce(length(text), -1)::int as size from content_list where block_id is not null",
    "prompt_lines": "select c_custkey, array_to_string(list_filter([case when trim(c_name) <> '' then 'name: ' || c_name end, case when c_acctbal > 0 and trim(c_mktsegment) <> '' then 'segment: ' || c_mktsegment end, 'key: ' || c_custkey], lambda x: x is not null), chr(10)) as lines from customer",
    "messages": "select c_custkey, case c_custkey % 3 when 0 then 'Hello ' || coalesce(c_name, '') when 1 then coalesce(c_name, '') || ' of ' || coalesce(c_mktsegment, '') else 'nobody' end as message from customer",
    "term_frequencies": f"with w as (select item_id, unnest(list_distinct({TOKENS})) as term from eval_items), d as (select term, count(*) as frequency from (select unnest(list_distinct({TOKENS})) as term from documents) group by 1 having count(*) > 5) select item_id, case when frequency is null then '' when regexp_matches(w.term, '^[a-z]+$') then 'latin' else 'other' end as tag, sum(coalesce(frequency, 0))::bigint as total, count(*) as n from w left join d using (term) group by 1, 2",
    "field_map_union": """with d as (select distinct kb_id, parser_config as c, create_time, document_id from kb_document where kb_id is not null and json_valid(parser_config)), e as (select *, unnest(json_keys(c)) as field from d),
      v as (select kb_id, field, create_time, document_id, c, case when json_type(c, '$."' || field || '"') = 'VARCHAR' then json_extract_string(c, '$."' || field || '"') else replace(json_extract(c, '$."' || field || '"')::varchar, ' ', '') end as value from e)
      select kb_id, field, value from (select *, row_number() over (partition by kb_id, field order by create_time desc nulls last, document_id desc nulls last, c desc) as rn from v) where rn = 1""",
}
