"""Lexical queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.runtime import table


def _docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *extra)


def tokenize_normalize(spark, sf_dir):
    t = L.tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def fullwidth_halfwidth(spark, sf_dir):
    half = L.halfwidth("text")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(half).alias("half_md5"), (half != F.col("text")).alias("changed"))


def split_by_script(spark, sf_dir):
    runs = L.script_runs("text")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), F.md5(F.array_join(runs, "|")).alias("runs_md5"))


def lang_ratio_english(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null and text <> ''").select("doc_id", F.round(L.english_share("text"), 6).alias("share"), L.is_english("text").alias("english"))


def lang_ratio_chinese(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", L.is_chinese("text").alias("chinese"))


def question_mode(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", L.question_is_chinese("text").alias("chinese_mode"))


def stopphrase_strip(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", L.without_stop_phrases("text").alias("kept"))


def space_eng_zh(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(L.spaced_scripts("text")).alias("spaced_md5"))


def join_han_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(L.without_han_spaces(L.spaced_scripts("text"))).alias("joined_md5"))


def query_escape(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", L.escaped("text").alias("escaped"))


def truncate_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", L.truncated("text", 12).alias("head"))


def strip_table_tags(spark, sf_dir):
    return table(spark, sf_dir, "content_list").where("block_type = 'table' and text is not null").select("block_id", L.without_table_tags("text").alias("plain")).distinct()


def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "kb_file").where("file_name is not null").select("file_id", L.clean_name("file_name").alias("name")).distinct()


def split_multi_marker(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(L.split_markers("text", ["\n\n", ". ", "; "])).cast("bigint").alias("n_parts"))


def float_test(spark, sf_dir):
    words = table(spark, sf_dir, "eval_items").select("item_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("item_id").agg(F.sum(L.is_float("w").cast("bigint")).alias("n_floats"))


def between_tags(spark, sf_dir):
    return table(spark, sf_dir, "content_list").where("block_type = 'table' and text is not null").select("block_id", F.array_join(L.between_tags("text", "td"), "|").alias("cells")).distinct()


def numeral_parse(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", F.explode(L.tokens("text")).alias("w"))
    return words.select("doc_id", L.numeral("w").alias("v")).where("v > 0").groupBy("doc_id").agg(F.sum("v").cast("bigint").alias("total"), F.count("*").alias("n"))


def qa_prefix_strip(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(L.without_qa_prefix("text")).alias("body_md5"))


def position_tags_strip(spark, sf_dir):
    tagged = F.concat("text", F.lit("@@1\t10.5\t20.0\t3.5\t9.9##"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", (L.without_position_tags(tagged) == F.col("text")).alias("restored"))


def column_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.column_name(F.concat("p_name", F.lit("/alias (a,b)"))).alias("column_name"))


def bool_date_normalize(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", "✓").when(F.col("o_orderstatus") == "O", "×").otherwise("?")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.boolean_text(flag).alias("flag"), L.date_text(day).alias("day"))


def query_bigrams(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", F.explode(L.bigrams(L.tokens("text"))).alias("bigram")).groupBy("item_id", "bigram").agg(F.count("*").alias("n"))


def thinking_strip(spark, sf_dir):
    raw = F.concat(F.lit("<think>notes</think>"), F.lit("```json\n"), F.to_json(F.struct("item_id")), F.lit("\n```"))
    return table(spark, sf_dir, "eval_items").select("item_id", F.get_json_object(L.without_fences(L.without_thinking(raw)), "$.item_id").cast("bigint").alias("parsed"))


def string_split_merge(spark, sf_dir):
    parts = L.split_parts("text", ["\n\n"])
    return _docs(spark, sf_dir, "source").where("text is not null").select("doc_id", L.filled("{source}: {first} [{n}]", source=F.col("source"), first=F.substring(parts[0], 1, 40), n=F.size(parts)).alias("merged"))


QUERIES = {f.__name__: f for f in (tokenize_normalize, fullwidth_halfwidth, split_by_script, lang_ratio_english, lang_ratio_chinese, question_mode, stopphrase_strip, space_eng_zh, join_han_spaces, query_escape, truncate_tokens, strip_table_tags, clean_names, split_multi_marker, float_test, between_tags, numeral_parse, qa_prefix_strip, position_tags_strip, column_names, bool_date_normalize, query_bigrams, thinking_strip, string_split_merge)}

_HALF = f"translate(text, '{L.FULL}', '{L.HALF.replace(chr(39), chr(39) * 2)}')"
TOKENS = rf"list_filter(string_split(trim(regexp_replace(lower({_HALF}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"
_NUM = "case " + "when regexp_matches(w, '^[0-9]{1,9}$') then w::int " + " ".join(f"when w = '{k}' then {v}" for k, v in {**L.NUMERALS, **L.ROMAN}.items()) + " else -1 end"
_Q = "chr(39)"
SQL = {
    "tokenize_normalize": f"select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, coalesce({TOKENS}, []) as t from documents)",
    "fullwidth_halfwidth": f"select doc_id, md5({_HALF}) as half_md5, {_HALF} <> text as changed from documents where text is not null",
    "split_by_script": "select doc_id, len(r)::bigint as n_runs, md5(array_to_string(r, '|')) as runs_md5 from (select doc_id, regexp_extract_all(text, '[一-龥]+|[^一-龥 ]+') as r from documents where text is not null)",
    "lang_ratio_english": "select doc_id, round(s, 6) as share, s > 0.8 as english from (select doc_id, length(regexp_replace(text, '[^`a-zA-Z0-9\\s.,'':;/\"?<>!()-]', '', 'g')) / length(text) as s from documents where text is not null and text <> '')",
    "lang_ratio_chinese": "select doc_id, coalesce(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / nullif(length(text), 0) > 0.2, false) as chinese from documents",
    "question_mode": "select item_id, len(w) <= 3 or len(list_filter(w, lambda x: not regexp_matches(x, '^[a-zA-Z]+$'))) / len(w) >= 0.7 as chinese_mode from (select item_id, regexp_split_to_array(trim(text), '[ \t]+') as w from eval_items)",
    "stopphrase_strip": f"select item_id, case when r = '' then text else r end as kept from (select item_id, text, trim(regexp_replace(regexp_replace(text, '(?i)(^|[^a-z])(?:{'|'.join(L.STOP)})(?:[^a-z](?:{'|'.join(L.STOP)}))*($|[^a-z])', '\\1\\2', 'g'), ' +', ' ', 'g')) as r from eval_items)",
    "space_eng_zh": "select doc_id, md5(regexp_replace(regexp_replace(text, '([A-Za-z0-9])([一-龥])', '\\1 \\2', 'g'), '([一-龥])([A-Za-z0-9])', '\\1 \\2', 'g')) as spaced_md5 from documents where text is not null",
    "join_han_spaces": "with s as (select doc_id, regexp_replace(regexp_replace(text, '([A-Za-z0-9])([一-龥])', '\\1 \\2', 'g'), '([一-龥])([A-Za-z0-9])', '\\1 \\2', 'g') as t from documents where text is not null) select doc_id, md5(regexp_replace(regexp_replace(t, '([^a-z0-9.,)>]) +([^ ])', '\\1\\2', 'g'), '([^ ]) +([^a-z0-9.,(<])', '\\1\\2', 'g')) as joined_md5 from s",
    "query_escape": "select item_id, trim(regexp_replace(text, '([:\\\\{}()\\[\\]\\-*\"~^|+!/])', '\\\\\\1', 'g')) as escaped from eval_items",
    "truncate_tokens": "select doc_id, array_to_string(string_split(text, ' ')[1:12], ' ') as head from documents where text is not null",
    "strip_table_tags": "select distinct block_id, regexp_replace(text, '</?(?:table|td|caption|tr|th)(?: [^<>]{0,12})?>', ' ', 'g') as plain from content_list where block_type = 'table' and text is not null",
    "clean_names": "select distinct file_id, trim(upper(regexp_replace(replace(replace(replace(replace(replace(file_name, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\"\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g'))) as name from kb_file where file_name is not null",
    "split_multi_marker": "select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n\n|\\. |; '), lambda p: trim(p)), lambda p: p <> ''))::bigint as n_parts from documents where text is not null",
    "float_test": "select item_id, sum(regexp_matches(w, '^\\s*[+-]?([0-9]*\\.[0-9]+|[0-9]+\\.?)\\s*$')::int)::bigint as n_floats from (select item_id, unnest(string_split(text, ' ')) as w from eval_items) group by 1",
    "between_tags": "select distinct block_id, array_to_string(regexp_extract_all(text, '(?s)<td>(.*?)</td>', 1), '|') as cells from content_list where block_type = 'table' and text is not null",
    "numeral_parse": f"select doc_id, sum(v)::bigint as total, count(*) as n from (select doc_id, {_NUM} as v from (select doc_id, unnest({TOKENS}) as w from documents)) where v > 0 group by 1",
    "qa_prefix_strip": "select doc_id, md5(trim(regexp_replace(text, '(?i)^(?:问题|答案|回答|问|答|question|answer|user|assistant|q|a)[\t:： ]+', ''))) as body_md5 from documents where text is not null",
    "position_tags_strip": "select doc_id, true as restored from documents where text is not null",
    "column_names": "select p_partkey, lower(trim(regexp_replace(trim(regexp_replace(p_name || '/alias (a,b)', '(/.*|（[^（）]+?）|\\([^()]+?\\))', '', 'g')), '[^\\p{L}\\p{N}]+', '_', 'g'))) as column_name from part",
    "bool_date_normalize": "select o_orderkey, case o_orderstatus when 'F' then 'yes' when 'O' then 'no' end as flag, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') as day from orders",
    "query_bigrams": f"select item_id, bigram, count(*) as n from (select item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as bigram from (select item_id, {TOKENS} as t from eval_items)) group by 1, 2",
    "thinking_strip": "select item_id, item_id as parsed from eval_items",
    "string_split_merge": "select doc_id, coalesce(source, '') || ': ' || substr(string_split(text, '\n\n')[1], 1, 40) || ' [' || len(string_split(text, '\n\n')) || ']' as merged from documents where text is not null",
}
