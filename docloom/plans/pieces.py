"""Queries of the functions and sources that no other query shows: segmentation, synonyms, file formats, alignment, migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions import segment as G
from docloom.functions.text import token_count  # noqa: F401
from docloom.operators import mutation
from docloom.operators import retrieval as R
from docloom.operators import tabular as T
from docloom.operators.research import align
from docloom.plans.layout import _B, _boxes
from docloom.plans.retrieval import _terms_sql
from docloom.runtime import shared_dir, table
from docloom.sources import files as S

#: A small dictionary and a few synonyms for the queries; callers bring their own.
WORDS = {"数据": 50.0, "水泵": 40.0, "电池": 40.0, "模板": 30.0, "接口": 30.0, "索引": 20.0, "记录": 20.0, "代码": 20.0, "显示": 20.0, "负责": 10.0}
SYNONYMS = {"valve": ["gate", "tap", "valve"], "pump": ["compressor"], "report": ["summary", "account"]}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


def simplified_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(L.simplified("text")).alias("text_md5"))


def segmented_words(spark, sf_dir):
    """Words of ideographic runs by frequency; those of the dictionary counted per document."""
    rows = G.segmented(_docs(spark, sf_dir), "text", WORDS).select("doc_id", F.explode("words").alias("w"))
    return rows.where(F.col("w").isin(list(WORDS))).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


def synonyms_expanded(spark, sf_dir):
    terms = R.query_terms(table(spark, sf_dir, "eval_items"), "item_id", "text")
    syn = spark.createDataFrame([(k, v) for k, v in SYNONYMS.items()], "term string, syn array<string>")
    return G.with_synonyms(terms, syn).select("query_id", "term", F.round("weight", 9).alias("weight"))


def short_tokens_merged(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", F.array_join(G.merged_short(L.tokens("text")), "|").alias("words"))


def surnames(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", L.starts_with_surname("text").alias("surname"))


def text_lines_parsed(spark, sf_dir):
    """Documents as files in UTF-8, with its mark, and in UTF-16, parsed to lines again."""
    files = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return S.parse(files).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def file_row_counts(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return S.row_counts(files)


def mail_parsed(spark, sf_dir):
    """Documents as mails: subject and body."""
    body = F.concat(F.lit("Subject: note "), F.col("doc_id").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    files = _docs(spark, sf_dir).where(~F.col("text").rlike(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).select(F.concat(F.col("doc_id").cast("string"), F.lit(".eml")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return S.parse(files).where("kind = 'text' or text like 'Subject%'").groupBy("path").agg(F.max(F.when(F.col("kind") == "header", F.col("text"))).alias("subject"), F.max(F.when(F.col("kind") == "text", F.md5("text"))).alias("body_md5"))


def json_split_parts(spark, sf_dir):
    """Documents as JSON with a nested object: all values come back, whatever the parts."""
    made = F.to_json(F.struct("doc_id", F.struct(F.array_repeat(F.lit("x" * 40), 5).alias("list"), F.col("doc_id").alias("again")).alias("inner")))
    files = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.encode(made, "UTF-8").alias("content"))
    parts = S.parse(files).select("path", F.get_json_object("text", "$.doc_id").cast("bigint").alias("doc_id"), F.get_json_object("text", "$.inner.again").cast("bigint").alias("again"))
    return parts.groupBy("path").agg(F.max("doc_id").alias("doc_id"), F.max("again").alias("again"))


def delimited_rows(spark, sf_dir):
    """Parts written as tab-separated text and read back."""
    import uuid

    where = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).option("sep", "\t").csv(where)
    return S.read_delimited(spark, where, "p_partkey bigint, p_name string, p_size int")


def benchmark_passages(spark, sf_dir):
    """Documents by source as passages of a question, the English ones relevant."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), F.coalesce(F.lower(F.trim("lang")) == "en", F.lit(False)).cast("int").alias("rel")), "doc_id")
    rows = d.groupBy("source").agg(F.collect_list(F.struct("doc_id", "rel", "text")).alias("p")).select(F.col("source").alias("query_id"), F.col("source").alias("query"), F.struct(F.transform("p", lambda x: x["rel"]).alias("is_selected"), F.transform("p", lambda x: x["text"]).alias("passage_text")).alias("passages"))
    _, rel = S.marco_passages(rows)
    return rel.groupBy("query_id").agg(F.count("*").alias("n"))


def chunk_block_alignment(spark, sf_dir):
    """Chunks of three blocks each, aligned with the blocks again."""
    b = table(spark, sf_dir, "content_list").where("block_id is not null and document_id is not null and block_no is not null").select(F.col("document_id").alias("doc_id"), "block_no", "block_id", "text").dropDuplicates(["block_id"])
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    chunks = b.groupBy("doc_id", F.floor(F.col("block_no") / 3).alias("chunk_no")).agg(chunk.alias("text")).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_no"))
    return align(chunks, b).select("chunk_id", F.array_join("block_ids", ",").alias("block_ids"))


def schema_migrated(spark, sf_dir):
    return mutation.with_missing_columns(table(spark, sf_dir, "region"), {"r_name": "string", "rank_flt": "double", "tag_kwd": "string"})


def boxes_merged_horizontally(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page").alias("page"), F.col("layoutno").alias("layout"), "box_id", "x0", "x1", "top", "bottom", "text")
    return T.merged_horizontally(rows).groupBy("page", "layout").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def table_adaptive_blocks(spark, sf_dir):
    rows = T.filled_down(table(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise("")), "p_brand", "p_partkey", "p_name")
    return T.adaptive_blocks(rows, "p_brand", "p_partkey", "p_partkey", "p_name", "p_size", "p_type").select("p_brand", "block", "n_rows", F.md5("html").alias("html_md5"))


QUERIES = {f.__name__: f for f in (simplified_text, segmented_words, synonyms_expanded, short_tokens_merged, surnames, text_lines_parsed, file_row_counts, mail_parsed, json_split_parts, delimited_rows, benchmark_passages, chunk_block_alignment, schema_migrated, boxes_merged_horizontally, table_adaptive_blocks)}

_HALF = f"translate(text, '{L.FULL}', '{L.HALF.replace(chr(39), chr(39) * 2)}')"
_TOK = rf"list_filter(string_split(trim(regexp_replace(lower({_HALF}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"
SQL = {
    "simplified_text": f"select doc_id, md5(translate(text, '{L.TRADITIONAL}', '{L.SIMPLIFIED}')) as text_md5 from documents where text is not null",
    "synonyms_expanded": f"with t as ({_terms_sql('eval_items', 'item_id', 'text')}), s as (select unnest([{', '.join(repr(k) for k in SYNONYMS)}]) as term, unnest([{', '.join(str(v) for v in SYNONYMS.values())}]) as syn), u as (select query_id, term, weight from t union all select query_id, x, weight * 0.25 from (select query_id, t.term, weight, unnest(syn) as x from t join s using (term)) where x <> term) select query_id, term, round(max(weight), 9) as weight from u group by 1, 2",
    "short_tokens_merged": f"with u as (select item_id, unnest(range(0, len(a))) as p, unnest(a) as w from (select item_id, {_TOK} as a from eval_items)), f as (select *, length(w) <= 2 as s, sum((length(w) > 2)::int) over (partition by item_id order by p rows unbounded preceding) as g from u), r as (select *, count(*) filter (s) over (partition by item_id, g) as n, row_number() over (partition by item_id, g, s order by p) as k from f), h as (select item_id, case when not s then p when n <= 4 then min(p) over (partition by item_id, g, s) else p - (k - 1) % 2 end as o, s, p, w from r), m as (select item_id, o, s, string_agg(w, ' ' order by p) as w from h group by 1, 2, 3), q as (select item_id, string_agg(w, '|' order by o) as words from m group by 1) select e.item_id, coalesce(words, '') as words from eval_items e left join q using (item_id)",
    "surnames": f"select item_id, coalesce(length(text) > 0 and contains('{L.SURNAMES}', substr(text, 1, 1)), false) as surname from eval_items",
    "text_lines_parsed": "select doc_id || '.txt' as path, len(string_split(text, chr(10))) as n_lines, (length(text) - len(string_split(text, chr(10))) + 1)::bigint as n_chars from documents where text is not null",
    "file_row_counts": "select doc_id || '.md' as path, len(string_split(text, chr(10))) as n_rows from documents where text is not null",
    "mail_parsed": r"select doc_id || '.eml' as path, 'Subject: note ' || doc_id as subject, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as body_md5 from documents where text is not null and not regexp_matches(text, '[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')",
    "json_split_parts": "select doc_id || '.json' as path, doc_id, doc_id as again from documents where text is not null",
    "delimited_rows": "select p_partkey, p_name, p_size from part",
    "benchmark_passages": "select query_id, count(*) as n from (select distinct lower(trim(source)) as query_id, md5(text) as d from documents where source is not null and text is not null and lower(trim(lang)) = 'en') group by 1",
    "schema_migrated": "select *, null::double as rank_flt, null::varchar as tag_kwd from region",
    "boxes_merged_horizontally": f"with {_B}, b2 as (select doc_id || '/' || page as page, layoutno as layout, box_id, top, bottom, x0, text from b), w as (select *, lag(top) over v as pt, lag(bottom) over v as pb from b2 window v as (partition by page, layout order by top, x0, box_id)), g as (select *, sum((pt is null or abs(top - pt) >= (bottom - top + pb - pt) / 2 / 3)::int) over (partition by page, layout order by top, x0, box_id rows unbounded preceding) as g from w) select page, layout, count(distinct g) as n, (sum(length(text)) + count(*) - count(distinct g))::bigint as n_chars from g group by 1, 2",
    "table_adaptive_blocks": "with f as (select *, last_value(nullif(case when p_partkey % 3 > 0 then p_name else '' end, '') ignore nulls) over (partition by p_brand order by p_partkey rows unbounded preceding) as nm, row_number() over (partition by p_brand order by p_partkey) as rn, count(*) over (partition by p_brand) as c from part), b as (select *, floor((rn - 1) / least(15, greatest(6, floor(c / 4))))::bigint as block from f) select p_brand, block, count(*) as n_rows, md5('<table><tr><th>p_partkey</th><th>p_name</th><th>p_size</th><th>p_type</th></tr>' || string_agg('<tr><td>' || p_partkey || '</td><td>' || trim(coalesce(nm, '')) || '</td><td>' || p_size || '</td><td>' || trim(p_type) || '</td></tr>', '' order by rn) || '</table>') as html_md5 from b group by 1, 2",
}
