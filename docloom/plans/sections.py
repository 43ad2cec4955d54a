"""Queries of the composed chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import token_count  # noqa: F401
from docloom.functions.queries import fine_pieces
from docloom.operators import chunking as C
from docloom.operators import sections as S
from docloom.plans.chunking import _D, _GT, _docs, _level, _lines, _nearest
from docloom.plans.lexical import TOKENS
from docloom.runtime import table


def _rows(spark, sf_dir):
    return C.with_levels(C.lines(_docs(spark, sf_dir)), 1)


def sections_hierarchical(spark, sf_dir):
    return S.hierarchical_merge(_rows(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def sections_with_paths(spark, sf_dir):
    return S.sections_under_headings(_rows(spark, sf_dir)).select("doc_id", "pos", F.md5("path").alias("path_md5"), "lone")


def sections_manual(spark, sf_dir):
    return S.manual_sections(_rows(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def sections_law_or_book(spark, sf_dir):
    return S.law_or_book(C.lines(_docs(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def question_pattern_vote(spark, sf_dir):
    return S.question_votes(C.lines(_docs(spark, sf_dir)))


def question_sections(spark, sf_dir):
    return S.question_sections(C.lines(_docs(spark, sf_dir))).select("doc_id", F.col("group").cast("bigint").alias("no"), "question", F.md5("answer").alias("answer_md5"))


def pairs_from_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("a"), "o_orderpriority", F.col("o_custkey").cast("string").alias("c"))
    return S.pairs_from_cells(rows, "o_orderkey", "a", "o_orderpriority", "c")


def chunk_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(",", "p_brand", F.lit(" v1.2 "), "p_type", F.lit("")).alias("t"))
    return S.tagged(rows, "p_name", "t").select("p_partkey", F.array_join("tag_kwd", "|").alias("tags"))


def table_row_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(": ", "p_name", F.col("p_size").cast("string")).alias("t"))
    return S.row_batches(rows, "t", "p_partkey", "p_brand").select("p_brand", "batch", F.md5("text").alias("text_md5"))


def chunks_tokenised(spark, sf_dir):
    rows = table(spark, sf_dir, "content_list").where("block_id is not null").select("block_id", "text").distinct()
    return S.tokenised(rows, "text", fine_pieces).select("block_id", F.md5("content_ltks").alias("ltks_md5"), F.md5("content_sm_ltks").alias("sm_md5"))


def chunks_with_images(spark, sf_dir):
    rows = table(spark, sf_dir, "content_list").where("block_id is not null and document_id is not null").select(F.col("document_id").alias("doc_id"), F.struct("block_no", "block_id").alias("pos"), "text", F.col("img_path").alias("image")).dropDuplicates(["doc_id", "pos"])
    return S.merged_with_images(rows).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.md5("text").alias("text_md5"), F.size("images").cast("bigint").alias("n_images"))


QUERIES = {f.__name__: f for f in (sections_hierarchical, sections_with_paths, sections_manual, sections_law_or_book, question_pattern_vote, question_sections, pairs_from_cells, chunk_tags, table_row_batches, chunks_tokenised, chunks_with_images)}

_N = r"len(regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]|[^\s\x{{4e00}}-\x{{9fff}}]+'))"
_SEC = f"{_lines()}, v as (select *, {_level(1)} as level from l where length(trim(text)) > 1 and not regexp_matches(trim(text), '^[0-9]+$')), {_nearest()}, us as (select distinct doc_id, unnest(parents) as pos from par), ev as (select * from par where level is null or (level >= 2 and not exists (select 1 from us where us.doc_id = par.doc_id and us.pos = par.pos))), pa as (select e.doc_id, e.pos, string_agg(v.text, chr(10) order by v.pos) as path from (select doc_id, pos, unnest(parents) as h from ev) e join v on v.doc_id = e.doc_id and v.pos = e.h group by 1, 2), sc as (select ev.doc_id, ev.pos, ev.level, ev.text, coalesce(path, '') as path, path is null as lone from ev left join pa on pa.doc_id = ev.doc_id and pa.pos = ev.pos)"
_QM = " ".join(f"when bool_or(regexp_matches(trim(text), '^(?:{p})') and not regexp_matches(trim(text), '{C.NO_BULLET}')) then {i}" for i, p in enumerate(S.QUESTIONS))
_QH = " or ".join(f"(pattern = {i} and regexp_matches(trim(text), '^(?:{p})') and not regexp_matches(trim(text), '{C.NO_BULLET}'))" for i, p in enumerate(S.QUESTIONS))


def _walk(rows: str, opens: str, size: str, joint: str) -> str:
    """rows sq (doc_id, i, t, n, g) from i = 1 -> ch (doc_id, chunk_no, t): a fold carried by a recursion over the rows of each document."""
    return (
        f"{rows}, wk as (select doc_id, i, 0 as k, n as size, g, t from sq where i = 1 union all select sq.doc_id, sq.i, case when {opens} then wk.k + 1 else wk.k end, case when {opens} then {size} else wk.size + sq.n end, case when {opens} then sq.g else wk.g end, case when {opens} then sq.t else wk.t || {joint} || sq.t end "
        "from wk join sq on sq.doc_id = wk.doc_id and sq.i = wk.i + 1), ch as (select doc_id, k as chunk_no, arg_max(t, i) as t from wk group by 1, 2)"
    )


SQL = {
    "sections_hierarchical": "with recursive "
    + _walk(
        f"{_SEC}, sq as (select doc_id, row_number() over (partition by doc_id order by coalesce(-level, -7), pos) as i, case when lone then {_N.format('text')} else 218 end as n, lone::int as g, case when lone then text else path || chr(10) || text end as t from sc)",
        "not (sq.g = 1 and sq.n + wk.size < 218)", "sq.n", "chr(10)",
    )
    + " select doc_id, chunk_no::int as chunk_no, md5(t) as text_md5 from ch",
    "sections_with_paths": f"with {_SEC} select doc_id, pos::int as pos, md5(path) as path_md5, lone from sc",
    "sections_manual": "with recursive "
    + _walk(
        f"{_lines()}, v as (select *, {_level(1)} as level from l), mo as (select doc_id, level as m from (select doc_id, level, row_number() over (partition by doc_id order by count(*) desc, level) as rn from v where level is not null group by 1, 2) where rn = 1), op as (select v.*, coalesce(coalesce(level, 99) <= coalesce(m, -1) and lag(coalesce(level, 99)) over (partition by v.doc_id order by pos) <> coalesce(level, 99), false) as o from v left join mo on mo.doc_id = v.doc_id), "
        f"sq as (select doc_id, pos + 1 as i, text as t, {_N.format('text')} as n, sum(o::int) over (partition by doc_id order by pos rows unbounded preceding) as g from op)",
        "not (wk.size < 32 or (wk.size < 1024 and sq.g = wk.g))", "sq.n", "chr(10)",
    )
    + " select doc_id, chunk_no::int as chunk_no, md5(t) as text_md5 from ch",
    "question_pattern_vote": f"with {_lines()} select doc_id, case {_QM} else -1 end as pattern from l group by 1",
    "question_sections": f"with {_lines()}, vo as (select doc_id, case {_QM} else -1 end as pattern from l group by 1), m as (select l.*, ({_QH}) as q from l join vo using (doc_id) where pattern >= 0), g as (select *, sum(q::int) over (partition by doc_id order by pos rows unbounded preceding) as g from m) select doc_id, g::bigint as no, max(case when q then text end) as question, md5(coalesce(string_agg(case when not q then text end, chr(10) order by pos), '')) as answer_md5 from g where g > 0 group by 1, 2",
    "pairs_from_cells": "with c as (select o_orderkey, list_filter([trim(case when o_orderkey % 3 = 0 then ' ' else o_orderstatus end), trim(o_orderpriority), trim(o_custkey::varchar)], lambda x: x is not null and x <> '') as c from orders) select o_orderkey, c[1] as question, c[2] as answer from c where len(c) >= 2",
    "chunk_tags": "select p_partkey, replace(trim(p_brand), '.', '_') || '|v1_2|' || replace(trim(p_type), '.', '_') as tags from part where trim(p_name) <> ''",
    "table_row_batches": "with n as (select *, row_number() over (partition by p_brand order by p_partkey) as rn from part) select p_brand, floor((rn - 1) / 10)::bigint as batch, md5(string_agg(p_name || ': ' || p_size, '; ' order by rn)) as text_md5 from n group by 1, 2",
    "chunks_tokenised": "with b as (select distinct block_id, text as raw, regexp_replace(text, '</?(?:table|td|caption|tr|th)(?: [^<>]{0,12})?>', ' ', 'g') as text from content_list where block_id is not null and trim(text) <> ''), t as (select block_id, {T} as t from b) select block_id, md5(array_to_string(t, ' ')) as ltks_md5, md5(array_to_string(list_transform(flatten(list_transform(t, lambda w: case when length(w) > 3 and regexp_matches(w, '^[一-鿿]+$') then list_transform(range(1, length(w), 2), lambda i: substr(w, i, case when i + 3 > length(w) then 3 else 2 end)) else [w] end)), lambda w: w), ' ')) as sm_md5 from t".replace("{T}", TOKENS),
    "chunks_with_images": "with recursive b as (select distinct document_id as doc_id, block_no, block_id, text, img_path from content_list where block_id is not null and document_id is not null), o as (select *, row_number() over (partition by doc_id, block_no, block_id order by text, img_path) as d from b), "
    + _walk(f"sq as (select doc_id, row_number() over (partition by doc_id order by block_no nulls first, block_id) as i, coalesce(text, '') as t, {_N.format("coalesce(text, '')")} as n, (img_path is not null)::bigint as g from o where d = 1)", "wk.size > 128", "sq.n", "chr(10)")
    + ", im as (select wk.doc_id, wk.k as chunk_no, sum(sq.g)::bigint as n_images from wk join sq on sq.doc_id = wk.doc_id and sq.i = wk.i group by 1, 2) select ch.doc_id, ch.chunk_no::bigint as chunk, md5(t) as text_md5, n_images from ch join im using (doc_id, chunk_no)",
}
