"""Metadata, join, aggregation, tree, permission and mutation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import metadata as M
from docloom.operators import mutation as U
from docloom.runtime import latest, small, table


def scan_project_chunks(spark, sf_dir):
    """Documents as chunks under their public names."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("kb_id").alias("dataset_id"), F.concat(F.lit("doc-"), "doc_id").alias("document_keyword"), F.length("text").cast("bigint").alias("size"))


def filter_terms_in(spark, sf_dir):
    return M.where_terms(table(spark, sf_dir, "documents"), lang=["en", "fr"], suffix="pdf").select("doc_id", "lang")


def filter_array_terms(spark, sf_dir):
    return M.where_terms(table(spark, sf_dir, "chunk_app"), page_num_int=[1, 3]).select("id").distinct()


def filter_available_null_safe(spark, sf_dir):
    return M.where_terms(table(spark, sf_dir, "chunk_app"), available_int=1).groupBy("kb_id").agg(F.count_distinct("id").alias("n"))


def filter_exists(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app")
    return rows.groupBy("doc_type_kwd").agg(F.sum(M.exists("important_kwd", True).cast("bigint")).alias("with_keywords"), F.sum((~F.coalesce(M.exists("tag_kwd", True), F.lit(False))).cast("bigint")).alias("without_tags"))


def filter_contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "kb_file").where(M.contains("file_name", "VALVE")).select("file_id").distinct()


def filter_like(spark, sf_dir):
    return table(spark, sf_dir, "knowledgebase").where("kb_name like '%notes%'").select("kb_id", "kb_name")


def filter_between(spark, sf_dir):
    return M.build_query(table(spark, sf_dir, "orders"), o_totalprice=[1000.0, 50000.0], o_orderstatus=["O", "F"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def filter_long_in(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    return M.in_list(table(spark, sf_dir, "orders"), "o_custkey", wanted, "c_custkey").agg(F.count("*").alias("n"))


def listing_page_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return M.listing(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 20)


def switch_route(spark, sf_dir):
    """First matching case of a switch over event fields."""
    v, t = F.col("value"), F.lower("event_type")
    case = F.when(t.contains("err") & (v > 5), "alarm").when(t.startswith("sign") | t.endswith("chase"), "growth").when((v >= 10) & (v < 50), "mid").when(F.coalesce(F.col("props"), F.lit("")) == "", "empty").otherwise("default")
    return table(spark, sf_dir, "events").groupBy(case.alias("route")).agg(F.count("*").alias("n"))


def facet_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


def facet_array_terms(spark, sf_dir):
    one = latest(table(spark, sf_dir, "chunk_app").select("id", "tag_kwd", "ingested_at"), ["id"], [F.col("ingested_at")])
    return one.select("id", F.explode("tag_kwd").alias("t")).select("id", F.lower(F.trim("t")).alias("tag")).where("tag <> ''").distinct().groupBy("tag").agg(F.count("*").alias("n"))


def facet_two_way_total(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"])
    return M.grouped_facets(docs, "suffix", "run_state")


def daily_usage_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("_v"), F.sum((F.col("event_type") == "purchase").cast("bigint")).alias("purchases"))
    return per.select("day", "n", "users", "purchases", F.round("_v", 4).alias("tokens"), F.round(F.col("_v") / (F.col("n") + 0.1), 6).alias("speed"))


def count_distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


def sum_size_coalesce(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"])
    return docs.groupBy("kb_id").agg(F.coalesce(F.sum("doc_size"), F.lit(0)).alias("total_size"), F.count("*").alias("n_docs"))


def token_accounting(spark, sf_dir):
    """Counters derived from the chunks, beside the stored ones."""
    chunks = table(spark, sf_dir, "chunk_app").groupBy("doc_id").agg(F.count_distinct("id").alias("derived"))
    docs = table(spark, sf_dir, "kb_document").select("document_id", "chunk_num").dropDuplicates(["document_id"])
    return docs.join(chunks, docs.document_id == chunks.doc_id, "left").select("document_id", "chunk_num", F.coalesce("derived", F.lit(0)).alias("derived"))


def mode_per_group(spark, sf_dir):
    return M.mode(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")


def distinct_sorted_concat(spark, sf_dir):
    return M.joined_values(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


def progress_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "purchase", 1.0).otherwise(F.least(F.col("value") / 100, F.lit(1.0)))
    return M.progress(e.select(F.col("user_id").alias("doc_id"), p.alias("progress"), F.col("event_type").alias("message")))


def permission_max_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").cast("string").alias("user_id"), (F.col("c_custkey") % 4).alias("role_id"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("kb"), (F.col("c_custkey") % 3).cast("string"))).alias("resource_id"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("expires_at"))
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), (F.col("n_nationkey") % 4).alias("role_id"), F.lit("kb1").alias("resource_id"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    members = c.select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").cast("string").alias("user_id"))
    perms = spark.createDataFrame([(0, "read", 1), (1, "read", 1), (1, "write", 2), (2, "write", 3), (3, "admin", 9)], "role_id int, permission string, level int")
    return M.effective_permissions(users, teams, members, perms, F.lit("2024-01-01").cast("timestamp_ntz"))


def permission_compare(spark, sf_dir):
    return M.compare_permissions(permission_max_merge(spark, sf_dir), "8", "13")


def join_inner_three_way(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").select("document_id", "doc_name").dropDuplicates(["document_id"])
    link = table(spark, sf_dir, "file2document").select(F.lower(F.trim("document_id")).alias("document_id"), F.lower(F.trim("file_id")).alias("file_id")).distinct()
    files = latest(table(spark, sf_dir, "kb_file").select("file_id", "file_name", "update_time"), ["file_id"], [F.col("update_time")]).drop("update_time")
    return docs.join(link, "document_id").join(files, "file_id").select("document_id", "file_id", "doc_name", "file_name")


def join_four_way(spark, sf_dir):
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def join_or_visibility(spark, sf_dir):
    """Datasets of others that are shared with the team, or one's own."""
    kb = table(spark, sf_dir, "knowledgebase")
    me = kb.agg(F.min("tenant_id").alias("me"))
    joined = kb.select("tenant_id").distinct().where("substring(tenant_id, 1, 1) < '8'")
    return kb.crossJoin(F.broadcast(me)).join(joined.withColumn("_j", F.lit(True)), "tenant_id", "left").where((F.col("_j") & (F.coalesce("status", F.lit("1")) == "1")) | (F.col("tenant_id") == F.col("me"))).select("kb_id")


def join_left_outer_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").select("document_id", "kb_id").dropDuplicates(["document_id"])
    link = table(spark, sf_dir, "file2document").select(F.lower(F.trim("document_id")).alias("document_id"), F.lower(F.trim("file_id")).alias("file_id")).distinct()
    files = latest(table(spark, sf_dir, "kb_file").select("file_id", "parent_id", "update_time"), ["file_id"], [F.col("update_time")])
    j = docs.join(link, "document_id", "left").join(files.select("file_id", "parent_id"), "file_id", "left")
    return j.select(F.coalesce("parent_id", "kb_id").alias("place"), "document_id").distinct()


def semi_in_subquery(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))


def anti_not_in_subquery(spark, sf_dir):
    """Customers without an order; the key is null-aware as NOT IN is."""
    c = table(spark, sf_dir, "customer")
    c.createOrReplaceTempView("_c")
    table(spark, sf_dir, "orders").where("o_totalprice > 400000").createOrReplaceTempView("_o")
    return spark.sql("select c_mktsegment, count(*) as n from _c where c_custkey not in (select o_custkey from _o where o_custkey is not null) group by 1")


def anti_cache_miss(spark, sf_dir):
    """Documents whose digest is not in the cache."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return d.join(d.where("doc_id % 2 = 0").select("digest"), "digest", "left_anti").select("doc_id")


def scalar_subquery_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    region = table(spark, sf_dir, "region")
    return n.join(per, "n_nationkey", "left").join(small(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name", F.coalesce("members", F.lit(0)).alias("members"))


def effective_row_filter(spark, sf_dir):
    """Only rows of resources on which somebody has a permission."""
    granted = permission_max_merge(spark, sf_dir).where("permission = 'write' and resource_id is not null").select(F.substring("resource_id", 3, 1).cast("bigint").alias("r")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("r")).join(small(granted), "r", "left_semi").select("doc_id")


def unique_name_suffix(spark, sf_dir):
    files = latest(table(spark, sf_dir, "kb_file").select("file_id", "tenant_id", "file_name", "update_time"), ["file_id"], [F.col("update_time")])
    return M.unique_names(files.select("file_id", "tenant_id", "file_name"), "file_name", "file_id", "tenant_id").select("file_id", "file_name")


def parser_config_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"])
    m = M.merged_config(F.col("parser_config"), F.lit('{"layout_recognize": "by_layout", "lang": "en"}'))
    return docs.select("document_id", m["layout_recognize"].alias("layout"), m["lang"].alias("lang"), m["pages"].alias("pages"))


def upsert_last_write(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").select("id", "available_int", "ingested_at")
    return U.upsert(rows.where("available_int = 1"), rows.where("available_int is null or available_int <> 1"), "id", "ingested_at").groupBy(F.coalesce("available_int", F.lit(-1)).alias("available")).agg(F.count("*").alias("n"))


def delete_by_predicate(spark, sf_dir):
    return U.delete(table(spark, sf_dir, "documents").select("doc_id", "source"), ids=[1, 2, 3], key="doc_id", where=F.lower(F.trim("source")) == "mail").groupBy("source").agg(F.count("*").alias("n"))


def update_array_element(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array(F.coalesce(F.trim("lang"), F.lit("none")), F.coalesce("suffix", F.lit("none"))).alias("tags"))
    rows = U.add_element(rows, F.col("doc_id") % 2 == 0, "tags", "even")
    return U.remove_element(rows, F.col("doc_id") % 3 == 0, "tags", "pdf").select("doc_id", F.array_join("tags", ",").alias("tags"))


def tag_rename(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array(F.coalesce(F.trim("lang"), F.lit("none")), F.coalesce("suffix", F.lit("none"))).alias("tags"))
    return U.rename_element(rows, F.lit(True), "tags", "pdf", "portable").select("doc_id", F.array_join("tags", ",").alias("tags"))


def availability_switch(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").select("id", "available_int", "kb_id")
    return U.update(rows, F.col("id").startswith("a"), available_int=F.lit(0)).groupBy(F.coalesce("available_int", F.lit(-1)).alias("available")).agg(F.count("*").alias("n"))


def doc_removal_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    graph = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("source_id"))
    _, kept = U.remove_documents(o, graph, o.where("doc_id % 3 = 0"))
    return kept.select("node", F.size("source_id").cast("bigint").alias("n_sources"))


def positions_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("size(position_int) > 0").select("id", "position_int").distinct()
    enc = U.encode_positions(F.col("position_int"))
    return rows.select("id", enc.alias("encoded"), F.size(U.decode_positions(enc)).cast("bigint").alias("n")).distinct()


def list_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("size(tag_kwd) > 0").select("id", U.encode_list(F.col("tag_kwd")).alias("encoded")).distinct()
    return rows.select("id", "encoded", F.size(U.decode_list(F.col("encoded"))).cast("bigint").alias("n"))


def concat_result_sets(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    b = table(spark, sf_dir, "documents").where("suffix = 'pdf'").select("doc_id")
    return a.unionByName(b).dropDuplicates(["doc_id"])


def array_set_ops(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("page_num_int is not null and top_int is not null").select("id", "page_num_int", "top_int").distinct()
    a, b = F.col("page_num_int"), F.col("top_int")
    return rows.select("id", F.size(F.array_intersect(a, b)).cast("bigint").alias("n_both"), F.size(F.array_union(a, b)).cast("bigint").alias("n_any"), F.size(F.array_except(a, b)).cast("bigint").alias("n_first")).distinct()


def heartbeat_expiry(spark, sf_dir):
    """Users seen within two minutes before the end count as alive, by hour."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = e.agg(F.max("ts").alias("end"))
    age = F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.crossJoin(F.broadcast(end)).select("user_id", (age <= 86400).alias("alive"))


def recent_unfinished(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"])
    return docs.where("progress > 0 and progress < 1").groupBy("run_state").agg(F.count("*").alias("n"))


def parse_done_check(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"]).where("kb_id is not null and trim(kb_id) <> ''")
    return docs.groupBy("kb_id").agg(F.bool_and(F.coalesce(F.col("progress") >= 1, F.lit(False))).alias("done"), F.count("*").alias("n"))


def running_totals(spark, sf_dir):
    """Running totals and ranks within groups, the window forms that listings need."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.row_number().over(w).alias("nth"))


QUERIES = {f.__name__: f for f in (scan_project_chunks, filter_terms_in, filter_array_terms, filter_available_null_safe, filter_exists, filter_contains_ci, filter_like, filter_between, filter_long_in, listing_page_total, switch_route, facet_terms, facet_array_terms, facet_two_way_total, daily_usage_stats, count_distinct_users, sum_size_coalesce, token_accounting, mode_per_group, distinct_sorted_concat, progress_rollup, permission_max_merge, permission_compare, join_inner_three_way, join_four_way, join_or_visibility, join_left_outer_chain, semi_in_subquery, anti_not_in_subquery, anti_cache_miss, scalar_subquery_counts, effective_row_filter, unique_name_suffix, parser_config_merge, upsert_last_write, delete_by_predicate, update_array_element, tag_rename, availability_switch, doc_removal_cascade, positions_codec, list_codec, concat_result_sets, array_set_ops, heartbeat_expiry, recent_unfinished, parse_done_check, running_totals)}

_DOC = "d as (select * from (select *, row_number() over (partition by document_id order by kb_id) as rn from kb_document) where rn = 1)"
_LINK = "k as (select distinct lower(trim(document_id)) as document_id, lower(trim(file_id)) as file_id from file2document)"
_FILE = "f as (select * from (select *, row_number() over (partition by file_id order by update_time desc nulls last) as rn from kb_file) where rn = 1)"
_PERM = """g as (select user_id, resource_id, permission, max(level) as level from (
      select c_custkey::varchar as user_id, c_custkey % 4 as role_id, case when c_custkey % 5 > 0 then 'kb' || (c_custkey % 3) end as resource_id from customer where c_custkey % 7 <> 0
      union all select c_custkey::varchar, n_nationkey % 4, 'kb1' from nation join customer on c_nationkey = n_nationkey)
    join (values (0, 'read', 1), (1, 'read', 1), (1, 'write', 2), (2, 'write', 3), (3, 'admin', 9)) p(role_id, permission, level) using (role_id) group by 1, 2, 3)"""
SQL = {
    "scan_project_chunks": "select doc_id, kb_id as dataset_id, 'doc-' || doc_id as document_keyword, length(text) as size from documents",
    "filter_terms_in": "select doc_id, lang from documents where lang in ('en', 'fr') and suffix = 'pdf'",
    "filter_array_terms": "select distinct id from chunk_app where list_has_any(page_num_int, [1, 3])",
    "filter_available_null_safe": "select kb_id, count(distinct id) as n from chunk_app where coalesce(available_int, 1) >= 1 group by 1",
    "filter_exists": "select doc_type_kwd, sum((important_kwd is not null and len(important_kwd) > 0)::int)::bigint as with_keywords, sum((not coalesce(len(tag_kwd) > 0, false))::int)::bigint as without_tags from chunk_app group by 1",
    "filter_contains_ci": "select distinct file_id from kb_file where contains(lower(file_name), 'valve')",
    "filter_like": "select kb_id, kb_name from knowledgebase where kb_name like '%notes%'",
    "filter_between": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice between 1000 and 50000 and o_orderstatus in ('O', 'F') group by 1",
    "filter_long_in": "select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')",
    "listing_page_total": "select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'P' order by o_totalprice desc, o_orderkey limit 20 offset 20",
    "switch_route": "select case when contains(lower(event_type), 'err') and value > 5 then 'alarm' when starts_with(lower(event_type), 'sign') or ends_with(lower(event_type), 'chase') then 'growth' when value >= 10 and value < 50 then 'mid' when coalesce(props, '') = '' then 'empty' else 'default' end as route, count(*) as n from events group by 1",
    "facet_terms": "select lower(trim(source)) as source, count(*) as n from documents group by 1",
    "facet_array_terms": "with l as (select id, tag_kwd, row_number() over (partition by id order by ingested_at desc nulls last) as rn from chunk_app) select tag, count(*) as n from (select distinct id, lower(trim(t)) as tag from (select id, unnest(tag_kwd) as t from l where rn = 1)) where tag <> '' group by 1",
    "facet_two_way_total": f"with {_DOC} select 'suffix' as facet, suffix as value, count(*) as n from d group by 2 union all select 'run_state', run_state, count(*) from d group by 2 union all select 'total', null, count(*) from d",
    "daily_usage_stats": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users, sum((event_type = 'purchase')::int)::bigint as purchases, round(sum(value), 4) as tokens, round(sum(value) / (count(*) + 0.1), 6) as speed from events group by 1",
    "count_distinct_users": "select event_type, count(distinct user_id) as users from events group by 1",
    "sum_size_coalesce": f"with {_DOC} select kb_id, coalesce(sum(doc_size), 0)::bigint as total_size, count(*) as n_docs from d group by 1",
    "token_accounting": f"with {_DOC} select document_id, chunk_num, coalesce(n, 0) as derived from d left join (select doc_id, count(distinct id) as n from chunk_app group by 1) c on doc_id = document_id",
    "mode_per_group": "select o_orderstatus, o_orderpriority, n from (select o_orderstatus, o_orderpriority, count(*) as n, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) as rn from orders group by 1, 2) where rn = 1",
    "distinct_sorted_concat": "select o_custkey, string_agg(o_orderstatus, '<SEP>' order by o_orderstatus) as o_orderstatus from (select distinct o_custkey, o_orderstatus from orders) group by 1",
    "progress_rollup": "with t as (select user_id as doc_id, case event_type when 'error' then -1.0 when 'purchase' then 1.0 else least(value / 100, 1.0) end::double as p, event_type as m from events), a as (select doc_id, round(avg(greatest(p, 0)), 6) as progress, min(p) as low, bool_and(p >= 1 or p < 0) as over, count(*) as n_tasks from t group by 1), b as (select doc_id, string_agg(m, chr(10) order by m) as messages from (select distinct doc_id, m from t) group by 1) select doc_id, progress, case when over and low < 0 then 'failed' when over then 'done' else 'running' end as state, messages, n_tasks from a join b using (doc_id)",
    "permission_max_merge": f"with {_PERM} select * from g",
    "permission_compare": f"with {_PERM}, a as (select coalesce(resource_id, '*') as resource_id, permission, level from g where user_id = '8'), b as (select coalesce(resource_id, '*') as resource_id, permission, level from g where user_id = '13') select resource_id, permission, coalesce(a.level, 0) as left_level, coalesce(b.level, 0) as right_level from a full join b using (resource_id, permission) where coalesce(a.level, 0) <> coalesce(b.level, 0)",
    "join_inner_three_way": f"with {_DOC}, {_LINK}, {_FILE} select document_id, file_id, doc_name, file_name from d join k using (document_id) join f using (file_id)",
    "join_four_way": "select n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "join_or_visibility": "select kb_id from knowledgebase where (substr(tenant_id, 1, 1) < '8' and coalesce(status, '1') = '1') or tenant_id = (select min(tenant_id) from knowledgebase)",
    "join_left_outer_chain": f"with {_DOC}, {_LINK}, {_FILE} select distinct coalesce(f.parent_id, d.kb_id) as place, d.document_id from d left join k using (document_id) left join f on k.file_id = f.file_id",
    "semi_in_subquery": "select p_brand, count(*) as n from part where p_partkey in (select l_partkey from lineitem where l_quantity > 48) group by 1",
    "anti_not_in_subquery": "select c_mktsegment, count(*) as n from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000 and o_custkey is not null) group by 1",
    "anti_cache_miss": "select doc_id from documents where md5(coalesce(text, '')) not in (select md5(coalesce(text, '')) from documents where doc_id % 2 = 0)",
    "scalar_subquery_counts": "select n_name, (select r_name from region where r_regionkey = n_regionkey) as r_name, (select count(*) from customer where c_nationkey = n_nationkey) as members from nation",
    "effective_row_filter": f"with {_PERM} select doc_id from documents where doc_id % 4 in (select substr(resource_id, 3, 1)::bigint from g where permission = 'write' and resource_id is not null)",
    "unique_name_suffix": f"with {_FILE}, n as (select file_id, file_name, row_number() over (partition by tenant_id, file_name order by file_id) - 1 as k from f) select file_id, case when k > 0 then regexp_replace(file_name, '\\.[^.]+$', '') || '(' || k || ')' || regexp_extract(file_name, '(\\.[^.]+)$', 1) else file_name end as file_name from n",
    "parser_config_merge": f"with {_DOC} select document_id, 'by_layout' as layout, 'en' as lang, replace(json_extract(parser_config, '$.pages')::varchar, ' ', '') as pages from d",
    "upsert_last_write": "select coalesce(available_int, -1) as available, count(*) as n from (select id, available_int, row_number() over (partition by id order by ingested_at desc, coalesce(available_int = 1, false)::int) as rn from (select distinct id, available_int, ingested_at from chunk_app)) where rn = 1 group by 1",
    "delete_by_predicate": "select source, count(*) as n from documents where doc_id not in (1, 2, 3) and not coalesce(lower(trim(source)) = 'mail', false) group by 1",
    "update_array_element": "with a as (select doc_id, [coalesce(trim(lang), 'none'), coalesce(suffix, 'none')] as t from documents), b as (select doc_id, case when doc_id % 2 = 0 then list_append(t, 'even') else t end as t from a) select doc_id, array_to_string(case when doc_id % 3 = 0 then list_filter(t, lambda x: x <> 'pdf') else t end, ',') as tags from b",
    "tag_rename": "select doc_id, array_to_string([coalesce(trim(lang), 'none'), case when coalesce(suffix, 'none') = 'pdf' then 'portable' else coalesce(suffix, 'none') end], ',') as tags from documents",
    "availability_switch": "select case when starts_with(id, 'a') then 0 else coalesce(available_int, -1) end as available, count(*) as n from chunk_app group by 1",
    "doc_removal_cascade": "select l_partkey as node, count(distinct l_orderkey) as n_sources from lineitem where l_orderkey % 3 <> 0 or l_orderkey not in (select o_orderkey from orders) group by 1",
    "positions_codec": "select distinct id, array_to_string(list_transform(position_int, lambda p: printf('%08x_%08x_%08x_%08x_%08x', p.page, p.x0, p.x1, p.top, p.bottom)), '_') as encoded, len(position_int) as n from chunk_app where len(position_int) > 0",
    "list_codec": "select distinct id, array_to_string(tag_kwd, '###') as encoded, len(list_filter(tag_kwd, lambda x: x <> '')) as n from chunk_app where len(tag_kwd) > 0",
    "concat_result_sets": "select doc_id from documents where lang = 'en' or suffix = 'pdf'",
    "array_set_ops": "select distinct id, len(list_intersect(list_distinct(page_num_int), list_distinct(top_int))) as n_both, len(list_distinct(list_concat(page_num_int, top_int))) as n_any, len(list_filter(list_distinct(page_num_int), lambda x: not list_contains(top_int, x))) as n_first from chunk_app where page_num_int is not null and top_int is not null",
    "heartbeat_expiry": "select user_id, epoch(date_trunc('second', (select max(ts) from events)))::bigint - epoch(date_trunc('second', max(ts)))::bigint <= 86400 as alive from events group by 1",
    "recent_unfinished": f"with {_DOC} select run_state, count(*) as n from d where progress > 0 and progress < 1 group by 1",
    "parse_done_check": f"with {_DOC} select kb_id, bool_and(coalesce(progress >= 1, false)) as done, count(*) as n from d where kb_id is not null and trim(kb_id) <> '' group by 1",
    "running_totals": "select o_orderkey, round(sum(o_totalprice) over w, 2) as running, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)",
}
