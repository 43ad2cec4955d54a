"""Chunking and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.lexical import delimiter_pattern
from docloom.operators import chunking as C
from docloom.operators import tabular as T
from docloom.plans.lexical import TOKENS
from docloom.runtime import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.lower(F.trim("source")).alias("source"))


def chunk_naive_merge(spark, sf_dir):
    return C.naive_merge(_docs(spark, sf_dir), 64).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def chunk_overlap(spark, sf_dir):
    return C.naive_merge(_docs(spark, sf_dir), 64, 0.2).select("doc_id", "chunk_no", F.length("text").alias("n_chars"))


def chunk_txt_merge(spark, sf_dir):
    return C.text_merge(_docs(spark, sf_dir), 64).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def chunk_markdown_smart(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "smart", least=20, most=120).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def chunk_markdown_advanced(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "advanced", target=80).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def chunk_strict_regex(spark, sf_dir):
    return C.strict_regex(_docs(spark, sf_dir), r"(?:[0-9]+\.[0-9]+ |#+ |Art\. )").select("doc_id", F.col("group").cast("bigint").alias("chunk_no"), F.md5("text").alias("text_md5"))


def chunk_qa_pairs(spark, sf_dir):
    return C.qa_pairs(C.lines(_docs(spark, sf_dir)), ": ").select("doc_id", F.col("group").cast("bigint").alias("pair_no"), "question", F.md5("answer").alias("answer_md5"))


def chunk_question_paths(spark, sf_dir):
    return C.question_paths(C.lines(_docs(spark, sf_dir))).select("doc_id", "question", F.md5("answer").alias("answer_md5"))


def bullet_family_vote(spark, sf_dir):
    return C.bullet_votes(C.lines(_docs(spark, sf_dir))).select("doc_id", "family", F.col("n").cast("bigint").alias("n"))


def title_frequency(spark, sf_dir):
    return C.title_level(C.with_levels(C.lines(_docs(spark, sf_dir)), 1))


def chunk_section_pivot(spark, sf_dir):
    rows = C.with_levels(C.lines(_docs(spark, sf_dir)), 1)
    return C.pivot_sections(rows, F.lit(3)).select("doc_id", F.col("group").cast("bigint").alias("section"), F.md5("text").alias("text_md5"))


def nearest_parent_level(spark, sf_dir):
    rows = C.nearest_parents(C.with_levels(C.lines(_docs(spark, sf_dir)), 1))
    return rows.where("level is not null").select("doc_id", "pos", "level", F.array_join("parents", ",").alias("parents"))


def heading_tree_bodies(spark, sf_dir):
    rows = C.with_levels(C.lines(_docs(spark, sf_dir)), 1)
    return C.heading_tree(rows).select("doc_id", "head", F.md5("body").alias("body_md5"))


def contents_removed(spark, sf_dir):
    """Each document behind a table of contents made of its own first word and the last one."""
    listed = F.concat(F.lit("Contents\n"), F.substring(F.split(F.col("text"), "\n")[0], 1, 12), F.lit(" 1\nAppendix 9\n"), F.col("text"))
    rows = C.lines(_docs(spark, sf_dir).select("doc_id", listed.alias("text")))
    return C.without_contents(rows).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first"))


def page_range_tasks(spark, sf_dir):
    docs = table(spark, sf_dir, "kb_document").dropDuplicates(["document_id"]).select(F.col("document_id").alias("doc_id"), F.col("chunk_num").alias("pages"), "parser_config")
    tasks = C.page_tasks(docs, "pages", 12)
    return tasks.join(docs.select("doc_id", "parser_config"), "doc_id").select("doc_id", "from_page", "to_page", C.task_digest(F.col("parser_config"), F.col("doc_id"), F.col("from_page"), F.col("to_page")).alias("digest"))


def task_reuse(spark, sf_dir):
    tasks = page_range_tasks(spark, sf_dir)
    done = tasks.where("from_page = 0").select("digest", F.concat(F.lit("chunks-"), "doc_id").alias("chunk_ids"))
    return C.reusable(tasks, done).groupBy("doc_id").agg(F.count("*").alias("n_tasks"), F.count("reused").alias("n_reused"))


def one_chunk_per_document(spark, sf_dir):
    return C.grouped_text(C.lines(_docs(spark, sf_dir)).withColumn("group", F.lit(0))).select("doc_id", F.md5("text").alias("text_md5"))


def chunk_by_page(spark, sf_dir):
    rows = table(spark, sf_dir, "content_list").where("text is not null").select(F.col("document_id").alias("doc_id"), F.col("page_idx").alias("page"), F.struct("block_no", "block_id").alias("pos"), "text").dropDuplicates(["pos"])
    return C.by_page(rows).select("doc_id", "page", F.md5("text").alias("text_md5"))


def column_type_vote(spark, sf_dir):
    return T.column_types(table(spark, sf_dir, "part"))


def table_rows_to_chunks(spark, sf_dir):
    return T.rows_to_chunks(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


def excel_html_blocks(spark, sf_dir):
    return T.html_blocks(table(spark, sf_dir, "part"), "p_partkey", 12, "p_partkey", "p_name", "p_size", within="p_brand").select("p_brand", "block", "html")


def cell_block_types(spark, sf_dir):
    cells = table(spark, sf_dir, "content_list").where("block_type = 'table' and text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("<td>(.*?)</td>"), F.lit(1))).alias("cell"))
    return cells.groupBy(T.block_type(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


def theta_box_overlap(spark, sf_dir):
    """Boxes of chunks that lie in boxes of other chunks of the same document page."""
    one = table(spark, sf_dir, "chunk_app").where("size(position_int) > 0").select("id", "doc_id", F.element_at("position_int", 1).alias("p")).dropDuplicates(["id"])
    box = one.select(F.concat_ws("/", "doc_id", F.col("p.page").cast("string")).alias("page"), "id", F.col("p.x0").alias("x0"), F.col("p.x1").alias("x1"), F.col("p.top").alias("top"), F.col("p.bottom").alias("bottom")).where("page is not null")
    pairs = T.overlaps(box.withColumnRenamed("id", "box_id"), box.withColumnRenamed("id", "region_id"), 0.4)
    return pairs.where("box_id <> region_id").select("box_id", "region_id", F.round("share", 6).alias("share"))


def box_non_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    box = li.select((F.col("l_suppkey") % 10).alias("page"), F.col("l_returnflag").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("box_id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 40).alias("x1"), (F.col("l_tax") * 500).alias("top"), (F.col("l_tax") * 500 + 30).alias("bottom"), F.col("l_extendedprice").alias("score"))
    return T.non_max(box.dropDuplicates(["box_id"])).select("box_id")


QUERIES = {f.__name__: f for f in (chunk_naive_merge, chunk_overlap, chunk_txt_merge, chunk_markdown_smart, chunk_markdown_advanced, chunk_strict_regex, chunk_qa_pairs, chunk_question_paths, bullet_family_vote, title_frequency, chunk_section_pivot, nearest_parent_level, heading_tree_bodies, contents_removed, page_range_tasks, task_reuse, one_chunk_per_document, chunk_by_page, column_type_vote, table_rows_to_chunks, excel_html_blocks, cell_block_types, theta_box_overlap, box_non_max)}

_D = "d as (select doc_id, text, lower(trim(source)) as source from documents where text is not null)"
_L = "l as (select doc_id, unnest(range(0, len(a))) as pos, unnest(a) as text from (select doc_id, source, string_split(text, chr(10)) as a from d where {w}))"
_GT = "string_agg(text, chr(10) order by pos)"


def _lines(where: str = "true") -> str:
    return f"{_D}, {_L.format(w=where)}"


def _level(family: int) -> str:
    return "case " + " ".join(f"when regexp_matches(trim(text), '^(?:{p})') and not regexp_matches(trim(text), '{C.NO_BULLET}') then {i}" for i, p in enumerate(C.BULLETS[family])) + " end"


_MD = r"regexp_matches(text, '^(#{1,6}) ')"
_OVER = "over (partition by doc_id order by pos rows unbounded preceding)"


def _nearest(levels: int = 6, upto: str = "1 preceding") -> str:
    """v (with level) -> par: the nearest heading of each level above a row, those behind a higher one left out."""
    last = ", ".join(f"max(case when level = {i} then pos end) over (partition by doc_id order by pos rows between unbounded preceding and {upto}) as p{i}" for i in range(levels))
    kept = ", ".join(f"case when coalesce(level, {levels}) > {i} and p{i} > greatest(-1{''.join(f', coalesce(p{k}, -1)' for k in range(i))}) then p{i} end" for i in range(levels))
    return f"np as (select *, {last} from v), par as (select doc_id, pos, text, level, list_filter([{kept}], lambda x: x is not null) as parents from np)"


_WORDS = r"len(regexp_extract_all({}, '\S+'))"


def _folded(pieces: str, opens: str, tail: str = "''", joint: str = "chr(10)") -> str:
    """pieces pc (doc_id, i, t, n), i from 1 -> fd (doc_id, k, t): a fold that opens a new chunk where ``opens`` holds of a (chunk, size) and the piece."""
    return (
        f"{pieces}, fo as (select doc_id, i, 0 as k, t, n from pc where i = 1 union all select pc.doc_id, pc.i, case when {opens} then fo.k + 1 else fo.k end, "
        f"case when {opens} then {tail} || pc.t else fo.t || {joint} || pc.t end, case when {opens} then {_WORDS.format(f'{tail} || pc.t')} else fo.n + pc.n end from fo join pc on pc.doc_id = fo.doc_id and pc.i = fo.i + 1), "
        "fd as (select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_no, t from (select doc_id, k, arg_max(t, i) as t from fo group by 1, 2) where trim(t, ' ' || chr(10) || chr(9)) <> '')"
    )


def _pieces(budget: int, delimiters: str, source: str | None = None) -> str:
    """Lines (of l, after ``source``) that are not blank, those at or above the budget cut at the delimiters."""
    cut = f"case when {_WORDS.format('text')} >= {budget} then regexp_split_to_array(text, '{delimiter_pattern(delimiters)}') else [text] end" if delimiters else "[text]"
    return (
        f"{source or _lines()}, cu as (select doc_id, pos, {cut} as a from l where trim(text, ' ' || chr(9) || chr(13)) <> ''), "
        "un as (select doc_id, pos, unnest(range(len(a))) as j, unnest(a) as t from cu), "
        f"pc as (select doc_id, row_number() over (partition by doc_id order by pos, j) as i, t, {_WORDS.format('t')} as n from un where trim(t, ' ' || chr(9) || chr(13)) <> '')"
    )


_SMART = (
    f"{_lines()}, fe as (select *, sum(starts_with(text, '```')::int) {_OVER} % 2 = 1 as fence from l), rw as (select *, not fence and starts_with(ltrim(text), '|') as is_row from fe), "
    "bl as (select *, sum((not is_row or not coalesce(was, false))::int) over (partition by doc_id order by pos rows unbounded preceding) as b from (select *, lag(is_row) over (partition by doc_id order by pos) as was from rw)), "
    f"kb as (select doc_id, b as i, string_agg(text, chr(10) order by pos) as t, any_value(case when is_row then 'table' when fence then 'text' when {_MD} then 'heading' when regexp_matches(text, '^(-{{3,}}|\\*{{3,}})\\s*$') then 'rule' else 'text' end) as kind from bl group by 1, 2), "
    f"sk as (select *, {_WORDS.format('t')} as n from kb), "
    "wk as (select doc_id, i, 0 as k, case when kind = 'rule' then null else t end as t, case when kind = 'rule' then 0 else n end as size from sk where i = 1 union all "
    "select doc_id, i, case when f then k + 1 else k end, case when kind = 'rule' then (case when f then null else old end) when f or old is null then new else old || chr(10) || new end, (case when f then 0 else size end) + (case when kind = 'rule' then 0 else n end) from "
    "(select sk.doc_id, sk.i, wk.k, wk.size, sk.n, sk.kind, wk.t as old, sk.t as new, wk.t is not null and ((wk.size >= 20 and (sk.kind in ('heading', 'rule') or (sk.kind = 'table' and sk.n > 60))) or wk.size + sk.n > 120) as f from wk join sk on sk.doc_id = wk.doc_id and sk.i = wk.i + 1)), "
    "ch as (select doc_id, k, arg_max(t, i) filter (t is not null) as t from wk group by 1, 2)"
)
_SECTIONS = (
    f"{_D}, {_L.format(w='true').replace('l as', 'l0 as', 1)}, fe as (select *, sum(starts_with(text, '```')::int) {_OVER} % 2 = 1 as fence from l0), hs as (select *, not fence and {_MD} and length(regexp_extract(text, '^(#{{1,6}}) ', 1)) <= 3 as h from fe), "
    f"sn as (select *, sum(h::int) {_OVER} as s from hs), se as (select doc_id as d, s, {_GT} as t from sn group by 1, 2), ok as (select *, contains(t, '```') or contains(t, chr(10) || '|') or {_WORDS.format('t')} <= 1.2 * 80 as whole from se where trim(t, ' ' || chr(10) || chr(9)) <> ''), "
    "l as (select d * 100000 + sn.s as doc_id, pos, text from sn join ok on ok.d = sn.doc_id and ok.s = sn.s where not whole)"
)
_ADVANCED = (
    f"{_folded(_pieces(80, chr(10) + '。；！？', _SECTIONS), 'fo.n > 80')}, al as (select d, s, 0 as j, t from ok where whole union all select doc_id // 100000, doc_id % 100000, chunk_no, t from fd), "
    f"sq as (select d as doc_id, row_number() over (partition by d order by s, j) as i, t, {_WORDS.format('t')} as n from al), "
    f"wk as (select doc_id, i, 0 as k, t, n from sq where i = 1 union all select sq.doc_id, sq.i, case when m then wk.k else wk.k + 1 end, case when m then wk.t || chr(10) || sq.t else sq.t end, case when m then {_WORDS.format('wk.t || chr(10) || sq.t')} else sq.n end from (select sq.*, wk.n < 40 and wk.n + sq.n <= 96 as m, wk.k as wk_k from wk join sq on sq.doc_id = wk.doc_id and sq.i = wk.i + 1) sq join wk on wk.doc_id = sq.doc_id and wk.i = sq.i - 1), "
    "ch as (select doc_id, k as chunk_no, arg_max(t, i) as t from wk group by 1, 2)"
)


_PG = "d as (select document_id as doc_id, chunk_num as pages, parser_config from (select *, row_number() over (partition by document_id order by kb_id) as rn from kb_document) where rn = 1 and chunk_num > 0), t as (select doc_id, from_page, least(from_page + 12, pages)::int as to_page, md5(concat_ws('|', parser_config, doc_id, from_page, least(from_page + 12, pages))) as digest from (select *, unnest(range(0, pages, 12))::int as from_page from d))"
SQL = {
    "chunk_naive_merge": f"with recursive {_folded(_pieces(64, chr(10) + '。；！？'), 'fo.n > 64')} select doc_id, chunk_no, md5(t) as text_md5 from fd",
    "chunk_overlap": f"with recursive {_folded(_pieces(64, chr(10) + '。；！？'), 'fo.n > 64 * 0.8', 'substr(fo.t, floor(length(fo.t) * 0.8)::int + 1)')} select doc_id, chunk_no, length(t)::int as n_chars from fd",
    "chunk_txt_merge": f"with recursive {_folded(_pieces(64, ''), 'fo.n > 64')} select doc_id, chunk_no, md5(t) as text_md5 from fd",
    "chunk_markdown_smart": f"with recursive {_SMART} select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_no, md5(t) as text_md5 from ch where trim(t, ' ' || chr(10) || chr(9)) <> ''",
    "chunk_markdown_advanced": f"with recursive {_ADVANCED} select doc_id, chunk_no, md5(t) as text_md5 from ch",
    "chunk_question_paths": f"""with {_lines()}, fe as (select *, sum(starts_with(text, '```')::int) {_OVER} as f from l),
      v as (select doc_id, pos, text, case when f % 2 = 0 and {_MD} then length(regexp_extract(text, '^(#{{1,6}}) ', 1)) - 1 end as level from fe),
      g as (select *, sum((level is not null)::int) {_OVER} as g, {', '.join(f"max(case when level = {i} then pos end) {_OVER} as p{i}" for i in range(6))} from v),
      h as (select doc_id, g, pos, text, list_filter([{', '.join(f"case when p{i} > greatest(-1{''.join(f', coalesce(p{k}, -1)' for k in range(i))}) then p{i} end" for i in range(6))}], lambda x: x is not null) as path from g where level is null),
      a as (select doc_id, g, any_value(path) as path, {_GT} as answer from h group by 1, 2),
      q as (select a.doc_id, a.g, string_agg(regexp_replace(v.text, '^(#{{1,6}}) ', ''), chr(10) order by v.pos) as question from (select doc_id, g, unnest(path) as p from a) a join v on v.doc_id = a.doc_id and v.pos = a.p group by 1, 2)
      select doc_id, question, md5(answer) as answer_md5 from a join q using (doc_id, g) where trim(answer) <> '' and question <> ''""",
    "nearest_parent_level": f"with {_lines()}, v as (select *, {_level(1)} as level from l), {_nearest()} select doc_id, pos::int as pos, level, array_to_string(parents, ',') as parents from par where level is not null",
    "heading_tree_bodies": f"with {_lines()}, v as (select *, {_level(1)} as level from l), hd as (select doc_id, pos as head, level from v where level is not null), en as (select a.doc_id, a.head, min(b.head) as stop from hd a left join hd b on a.doc_id = b.doc_id and b.head > a.head and b.level <= a.level group by 1, 2), bo as (select en.doc_id, en.head, string_agg(v.text, chr(10) order by v.pos) as body from en join v on v.doc_id = en.doc_id and v.pos > en.head and (stop is null or v.pos < stop) group by 1, 2) select doc_id, head::int as head, md5(body) as body_md5 from bo",
    "contents_removed": "with d as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null), f as (select doc_id, a, trim(substr(a[1], 1, 12)) as t from d), x as (select doc_id, ['Contents', substr(a[1], 1, 12) || ' 1', 'Appendix 9'] || a as a from d), l as (select doc_id, unnest(range(0, len(a))) as pos, unnest(a) as text from x), fi as (select doc_id, min(pos) as first, substr(trim(arg_min(text, pos)), 1, 8) as prefix from l where pos > 0 and trim(text) <> '' group by 1), ag as (select l.doc_id, min(pos) as again from l join fi using (doc_id) where pos > first and pos <= first + 128 and starts_with(trim(text), prefix) group by 1) select l.doc_id, count(*) as n_lines, min(pos)::int as first from l left join ag using (doc_id) where again is null or pos >= again group by 1",
    "cell_block_types": "with b as (select unnest(regexp_extract_all(text, '<td>(.*?)</td>', 1)) as c from content_list where block_type = 'table' and text is not null), t as (select trim(c) as text from b), k as (select text, len(list_filter({_TOK}, lambda w: length(w) > 1)) as n from t) select case {_CASES} when n >= 12 then 'Lx' when n > 3 then 'Tx' else 'Ot' end as kind, count(*) as n from k group by 1".replace("{_TOK}", TOKENS).replace("{_CASES}", " ".join(f"when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for p, k in T.CELL_CLASSES)),
    "box_non_max": """with recursive d as (select l_suppkey % 10 as page, l_returnflag as kind, concat_ws('-', l_orderkey, l_linenumber, l_partkey) as box_id, l_quantity * 10 as x0, l_quantity * 10 + 40 as x1, l_tax * 500 as t, l_tax * 500 + 30 as b, l_extendedprice as score from lineitem),
      s as (select *, row_number() over (partition by page, kind order by score desc, box_id) as i from (select distinct on (box_id) * from d) where score > 0),
      r(page, kind, i, kept) as (select page, kind, i, [{'id': box_id, 'x0': x0, 'x1': x1, 't': t, 'b': b}] from s where i = 1 union all
        select s.page, s.kind, s.i, case when len(list_filter(kept, lambda k: greatest(0, least(k.x1, s.x1) - greatest(k.x0, s.x0)) * greatest(0, least(k.b, s.b) - greatest(k.t, s.t)) >= 0.2 * ((k.x1 - k.x0) * (k.b - k.t) + (s.x1 - s.x0) * (s.b - s.t) - greatest(0, least(k.x1, s.x1) - greatest(k.x0, s.x0)) * greatest(0, least(k.b, s.b) - greatest(k.t, s.t))))) > 0
          then kept else list_append(kept, {'id': box_id, 'x0': x0, 'x1': x1, 't': t, 'b': b}) end from r join s on r.page = s.page and r.kind = s.kind and s.i = r.i + 1)
      select k.id as box_id from (select unnest(kept) as k from (select kept, row_number() over (partition by page, kind order by i desc) as rn from r) where rn = 1)""",
    "chunk_strict_regex": f"with {_lines()}, g as (select *, sum(regexp_matches(text, '^\\s*(?:(?:[0-9]+\\.[0-9]+ |#+ |Art\\. ))')::int) over (partition by doc_id order by pos rows unbounded preceding) as g from l), c as (select doc_id, g::bigint as chunk_no, {_GT} as t from g group by 1, 2) select doc_id, chunk_no, md5(t) as text_md5 from c where trim(t) <> ''",
    "chunk_qa_pairs": f"with {_lines()}, p as (select *, string_split(text, ': ') as a from l), g as (select *, sum((len(a) = 2)::int) over (partition by doc_id order by pos rows unbounded preceding) as g from p) select doc_id, g::bigint as pair_no, max(case when len(a) = 2 then a[1] end) as question, md5(string_agg(case when len(a) = 2 then a[2] else text end, chr(10) order by pos)) as answer_md5 from g where g > 0 group by 1, 2",
    "bullet_family_vote": f"with {_lines()}, v as (select doc_id, " + ", ".join(f"sum((regexp_matches(trim(text), '^(?:{'|'.join(f)})') and not regexp_matches(trim(text), '{C.NO_BULLET}'))::int) as n{i}" for i, f in enumerate(C.BULLETS)) + " from l group by 1) select doc_id, case when greatest(n0, n1, n2, n3) = 0 then -1 when n0 = greatest(n0, n1, n2, n3) then 0 when n1 = greatest(n0, n1, n2, n3) then 1 when n2 = greatest(n0, n1, n2, n3) then 2 else 3 end as family, greatest(n0, n1, n2, n3)::bigint as n from v",
    "title_frequency": f"with {_lines()}, v as (select doc_id, {_level(1)} as level from l) select doc_id, level from (select doc_id, level, row_number() over (partition by doc_id order by count(*) desc, level) as rn from v where level is not null group by 1, 2) where rn = 1",
    "chunk_section_pivot": f"with {_lines()}, v as (select *, {_level(1)} as level from l), o as (select *, coalesce(level <= 3 and lag(level) over (partition by doc_id order by pos) is distinct from level, false)::int as o from v), g as (select *, sum(o) over (partition by doc_id order by pos rows unbounded preceding) as g from o) select doc_id, g::bigint as section, md5({_GT}) as text_md5 from g group by 1, 2",
    "page_range_tasks": f"with {_PG} select * from t",
    "task_reuse": f"with {_PG} select doc_id, count(*) as n_tasks, count(*) filter (from_page = 0) as n_reused from t group by 1",
    "one_chunk_per_document": "select doc_id, md5(text) as text_md5 from documents where text is not null",
    "chunk_by_page": "with b as (select distinct on (block_no, block_id) * from content_list where text is not null) select document_id as doc_id, page_idx as page, md5(string_agg(text, chr(10) order by block_no, block_id)) as text_md5 from b group by 1, 2",
    "column_type_vote": "with c as (select unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) as cn, unnest([p_partkey::varchar, p_name, p_brand, p_type, p_size::varchar, p_retailprice::varchar]) as v from part), k as (select cn, case when regexp_matches(trim(v), '(?i)^(true|yes|false|no|是|否|✓|×)$') then 'bool' when regexp_matches(trim(v), '^[+-]?[0-9]{1,18}$') then 'int' when regexp_matches(trim(v), '^[+-]?[0-9]*\\.?[0-9]+$') then 'float' when regexp_matches(trim(v), '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9:.]+)?$') then 'datetime' else 'text' end as kind from c where trim(v) <> ''), n as (select cn, kind, count(*) as n from k group by 1, 2), b as (select cn, arg_max(kind, (n, kind)) as kind, max(n) as n, max(case when kind = 'float' then n end) as f from n group by 1) select cn as column, case when kind = 'int' and f > 0 then 'float' else kind end as kind, n from b",
    "table_rows_to_chunks": "select p_partkey, 'p_name: ' || p_name || '; p_brand: ' || p_brand || '; p_type: ' || p_type || '; p_size: ' || p_size as text from part",
    "excel_html_blocks": "with n as (select *, row_number() over (partition by p_brand order by p_partkey) as rn from part) select p_brand, floor((rn - 1) / 12)::bigint as block, '<table><tr><th>p_partkey</th><th>p_name</th><th>p_size</th></tr>' || string_agg('<tr><td>' || p_partkey || '</td><td>' || p_name || '</td><td>' || p_size || '</td></tr>', '' order by rn) || '</table>' as html from n group by 1, 2",
    "theta_box_overlap": "with o as (select distinct on (id) id, doc_id, position_int[1] as p from chunk_app where len(position_int) > 0), b as (select doc_id, p.page as page, id, p.x0 as x0, p.x1 as x1, p.top as t, p.bottom as b from o where p.x1 > p.x0 and p.bottom > p.top) select x.id as box_id, y.id as region_id, round((least(x.x1, y.x1) - greatest(x.x0, y.x0))::double * (least(x.b, y.b) - greatest(x.t, y.t)) / ((x.x1 - x.x0) * (x.b - x.t)), 6) as share from b x join b y on x.doc_id = y.doc_id and x.page = y.page and x.id <> y.id where least(x.x1, y.x1) > greatest(x.x0, y.x0) and least(x.b, y.b) > greatest(x.t, y.t) and (least(x.x1, y.x1) - greatest(x.x0, y.x0))::double * (least(x.b, y.b) - greatest(x.t, y.t)) / ((x.x1 - x.x0) * (x.b - x.t)) >= 0.4",
}
