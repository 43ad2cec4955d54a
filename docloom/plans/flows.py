"""Sources, dataflow, user functions and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docloom.operators import dag
from docloom.runtime import table
from docloom.sources import files as S
from docloom.streaming import ingest


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "content_list").where("block_type = 'table' and text like '<table%'").select("block_id", S.html_text("text").alias("plain")).distinct()


def markdown_tables(spark, sf_dir):
    src = F.concat(F.coalesce("text", F.lit("")), F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\nend"))
    found, rest = S.markdown_tables(src)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("n_tables"), F.length(rest).cast("bigint").alias("rest_chars"))


def markdown_image_urls(spark, sf_dir):
    src = F.concat(F.lit("see ![fig]("), F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")), F.lit(") here"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.image_urls(src), ",").alias("urls"))


def json_flatten_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def jsonl_detect(spark, sf_dir):
    text = F.when(F.col("user_id") % 2 == 0, F.concat("props", F.lit("\n"), "props", F.lit("\n"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", S.is_jsonl(text).alias("jsonl"))


def format_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "kb_file").select(F.coalesce(S.format_of("file_name"), F.lit("other")).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


def web_hit_chunks(spark, sf_dir):
    hits = table(spark, sf_dir, "eval_items").select("item_id", F.concat(F.lit("![x](data:image/png;base64,AAAA) "), "text").alias("content"), F.when(F.col("item_id") % 2 == 0, 0.5).alias("score"))
    return S.web_hits(hits, "content", "score").select("item_id", "chunk_id", "score")


def flow_switch_iterate(spark, sf_dir):
    flow = dag.Flow()
    flow.add("route", dag.switch(alarm=F.col("event_type") == "error", money=F.col("event_type") == "purchase"), "events")
    flow.add("alarms", lambda df: df.withColumn("score", F.col("value") * 2), "route:alarm")
    flow.add("others", lambda a, b: a.unionByName(b).withColumn("score", F.col("value")), "route:money", "route:default")
    flow.add("all", lambda a, b: a.unionByName(b).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score")), "alarms", "others")
    return flow.add("events", lambda: None).compile(events=table(spark, sf_dir, "events"))["all"]


def iterate_array(spark, sf_dir):
    df = table(spark, sf_dir, "chunk_app").where("size(tag_kwd) > 0").select("id", "tag_kwd").distinct()
    return dag.iterate("tag_kwd", lambda x: F.upper(F.trim(x)), "out")(df).select("id", F.array_join("out", ",").alias("out")).distinct()


def categorize_mentions(spark, sf_dir):
    return dag.categorize("text", ["pipeline", "sensor", "ticket"])(table(spark, sf_dir, "documents")).groupBy("category").agg(F.count("*").alias("n"))


def udf_scalar(spark, sf_dir):
    """A user's vectorised function, called from SQL."""

    @F.pandas_udf("bigint")
    def vowels(s: pd.Series) -> pd.Series:
        return s.fillna("").str.count("[aeiou]")

    reg = dag.Registry()
    reg.add("vowels", vowels)
    reg.register(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("vowels(text)").alias("n_vowels"))


def udf_grouped_agg(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(spread("o_totalprice"), 4).alias("spread"))


def udtf_split(spark, sf_dir):
    @F.udtf(returnType="word string, pos int")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split(" ")):
                yield w, i

    reg = dag.Registry()
    reg.add("words_of", Words, "udtf")
    reg.register(spark)
    table(spark, sf_dir, "eval_items").createOrReplaceTempView("_items")
    return spark.sql("select item_id, w.pos, w.word from _items, lateral words_of(text) w")


def stream_progress_monotone(spark, sf_dir):
    e = ingest.files_stream(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "error", -1.0).otherwise(F.least(F.col("value") / 100, F.lit(1.0)))
    out = ingest.monotone_progress(e.select("user_id", p.alias("p")), "user_id", "p")
    return ingest.run_to_table(spark, out).select("user_id", F.round("progress", 6).alias("progress"))


def stream_windows(spark, sf_dir):
    e = ingest.files_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windows(e, "ts", "1 day", "1 hour", "event_type").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return ingest.run_to_table(spark, out, "append")


def stream_dedup_upsert(spark, sf_dir):
    """Deliveries of chunks through an upsert sink: the last one of each id stays."""
    import uuid

    from docloom.runtime import shared_dir

    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = ingest.files_stream(spark, sf_dir, "file2document").select("link_id", "file_id", "document_id", "create_time")
    q = s.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(ingest.upsert_into(f"{where}/out", "link_id", "create_time")).start()
    q.awaitTermination()
    return ingest.upserted(spark, f"{where}/out", "link_id", "create_time").select("link_id", "create_time")


def retry_states(spark, sf_dir):
    return ingest.retried(table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("failed")), "user_id", "failed").groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (html_to_text, markdown_tables, markdown_image_urls, json_flatten_props, jsonl_detect, format_dispatch, web_hit_chunks, flow_switch_iterate, iterate_array, categorize_mentions, udf_scalar, udf_grouped_agg, udtf_split, stream_progress_monotone, stream_windows, stream_dedup_upsert, retry_states)}

_FMT = "case " + " ".join(f"when regexp_matches(file_name, '{p}') then '{n}'" for n, p in S.FORMATS) + " else 'other' end"
_CNT = lambda w: f"(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{w}', ''))) / {len(w)}"
SQL = {
    "html_to_text": "with t as (select distinct block_id, regexp_replace(regexp_replace(text, '(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/table|/td)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') as s from content_list where block_type = 'table' and text like '<table%') select block_id, array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as plain from t",
    "markdown_tables": f"with s as (select doc_id, coalesce(text, '') || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || 'end' as t from documents) select doc_id, len(regexp_extract_all(t, '{S.MD_TABLE}')) + len(regexp_extract_all(t, '{S.HTML_TABLE}')) as n_tables, length(regexp_replace(regexp_replace(t, '{S.MD_TABLE}', chr(10), 'g'), '{S.HTML_TABLE}', chr(10), 'g')) as rest_chars from s",
    "markdown_image_urls": "select doc_id, 'img/' || doc_id || '.png' as urls from documents",
    "json_flatten_props": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "jsonl_detect": "select event_id, user_id % 2 = 0 as jsonl from events",
    "format_dispatch": f"select {_FMT} as format, count(*) as n from kb_file group by 1",
    "web_hit_chunks": "select item_id, md5(' ' || text) as chunk_id, case when item_id % 2 = 0 then 0.5 else 1.0 end::double as score from eval_items",
    "flow_switch_iterate": "select event_type, count(*) as n, round(sum(case when event_type = 'error' then value * 2 else value end), 4) as score from events group by 1",
    "iterate_array": "select distinct id, array_to_string(list_transform(tag_kwd, lambda x: upper(trim(x))), ',') as out from chunk_app where len(tag_kwd) > 0",
    "categorize_mentions": f"with n as (select {_CNT('pipeline')} as a, {_CNT('sensor')} as b, {_CNT('ticket')} as c from documents) select case when greatest(a, b, c) = 0 then 'other' when a = greatest(a, b, c) then 'pipeline' when b = greatest(a, b, c) then 'sensor' else 'ticket' end as category, count(*) as n from n group by 1",
    "udf_scalar": "select doc_id, length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) as n_vowels from documents",
    "udf_grouped_agg": "select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 4) as spread from orders group by 1",
    "udtf_split": "select item_id, pos, word from (select item_id, unnest(range(0, len(a)))::int as pos, unnest(a) as word from (select item_id, string_split(text, ' ') as a from eval_items))",
    "stream_progress_monotone": "select user_id, round(case when min(p) < 0 then -1.0 else max(p) end, 6) as progress from (select user_id, case event_type when 'error' then -1.0 else least(value / 100, 1.0) end as p from events) group by 1",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by 1, 2",
    "stream_dedup_upsert": "select link_id, max(create_time) as create_time from file2document group by 1",
    "retry_states": "select case when f >= 3 then 'abandoned' when f > 0 then 'retry' else 'ok' end as state, count(*) as n from (select user_id, sum((event_type = 'error')::int) as f from events group by 1) group by 1",
}
