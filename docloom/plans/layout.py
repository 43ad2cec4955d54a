"""Layout queries. The boxes are those of the chunks: first position, current delivery; the text is the first line of the content."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import layout as L
from docloom.runtime import latest, materialize, table

#: The classes that the boxes stand in for, by the left edge of a region.
_KINDS = ["text", "title", "footer", "text", "header", "table", "text", "equation", "reference", "figure caption"]


def _boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_app").where("id is not null and doc_id is not null").select("id", "doc_id", "content_with_weight", "position_int", "ingested_at")
    one = latest(rows, ["id"], [F.col("ingested_at")]).where("size(position_int) > 0").withColumn("p", F.element_at("position_int", 1))
    text = F.split(F.coalesce("content_with_weight", F.lit("")), "\n")[0]
    num = lambda c: F.col(f"p.{c}").cast("double").alias(c)
    return one.select("doc_id", F.col("p.page").alias("page"), F.col("id").alias("box_id"), num("x0"), num("x1"), num("top"), num("bottom"), text.alias("text"), (F.col("p.x0") % 3).cast("string").alias("layoutno"), F.when(F.col("p.x0") % 4 == 0, "title").alias("layout_type"))


def boxes_in_order(spark, sf_dir):
    return L.in_reading_order(_boxes(spark, sf_dir), 10.0).select("box_id", F.col("place").cast("bigint").alias("place"))


def boxes_merged_vertically(spark, sf_dir):
    out = L.merged_vertically(L.in_reading_order(_boxes(spark, sf_dir), 10.0))
    return out.select("doc_id", F.col("group").cast("bigint").alias("box_group"), "page", "x0", "x1", "n_boxes", F.md5("text").alias("text_md5"))


def boxes_merged_by_bullet(spark, sf_dir):
    bulleted = _boxes(spark, sf_dir).withColumn("text", F.concat(F.when(F.col("page") % 2 == 0, "• ").otherwise("- "), "text"))
    return L.merged_by_bullet(L.in_reading_order(bulleted, 10.0)).select("doc_id", F.col("group").cast("bigint").alias("box_group"), "n_boxes", F.md5("text").alias("text_md5"))


def pages_without_leaders(spark, sf_dir):
    """Every third box ends in dot leaders."""
    led = _boxes(spark, sf_dir).withColumn("text", F.when(F.col("x0") % 3 == 0, F.concat("text", F.lit(" ······ 7"))).otherwise(F.col("text")))
    return L.without_leader_pages(led, 1).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def boxes_without_scraps(spark, sf_dir):
    return L.without_scraps(L.in_reading_order(_boxes(spark, sf_dir), 10.0), 600.0).select("box_id", F.col("scrap").cast("bigint").alias("scrap"))


def boxes_with_layout(spark, sf_dir):
    """Each box against the regions that the boxes themselves are, widened by ten units."""
    boxes = materialize(_boxes(spark, sf_dir).drop("layoutno", "layout_type"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.pmod(F.col("x0"), F.lit(10)) + 1).cast("int"))
    regions = boxes.select("doc_id", "page", F.col("box_id").alias("region_id"), kind.alias("kind"), (F.col("x0") - 10).alias("x0"), (F.col("x1") + 10).alias("x1"), (F.col("top") - 10).alias("top"), (F.col("bottom") + 10).alias("bottom"))
    return L.with_layout(boxes, regions, 800.0).select("box_id", "layout_type", "layoutno")


def tables_assembled(spark, sf_dir):
    """The lines of an order as a table: one row per line, its number, part and quantity in columns."""
    li = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")).dropDuplicates(["l_orderkey", "l_linenumber"])
    cell = lambda i, c: F.struct(F.lit(i).alias("col_no"), F.col(c).cast("string").alias("text"))
    cells = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_no"), F.explode(F.array(cell(0, "l_linenumber"), cell(4, "l_partkey"), cell(7, "q"))).alias("e"))
    cells = cells.select("table_id", F.concat_ws("-", "row_no", "e.col_no").alias("box_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), "e.text", "row_no", "e.col_no", (F.col("row_no") == 1).alias("header"))
    return L.assembled_tables(cells).select("table_id", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_cols").cast("bigint").alias("n_cols"), F.md5("html").alias("html_md5"))


QUERIES = {f.__name__: f for f in (boxes_in_order, boxes_merged_vertically, boxes_merged_by_bullet, pages_without_leaders, boxes_without_scraps, boxes_with_layout, tables_assembled)}

_B = "o as (select *, row_number() over (partition by id order by ingested_at desc nulls last) as rn from chunk_app where id is not null and doc_id is not null), b as (select doc_id, p.page as page, id as box_id, p.x0::double as x0, p.x1::double as x1, p.top::double as top, p.bottom::double as bottom, string_split(coalesce(content_with_weight, ''), chr(10))[1] as text, (p.x0 % 3)::varchar as layoutno, case when p.x0 % 4 = 0 then 'title' end as layout_type from (select *, position_int[1] as p from o where rn = 1 and len(position_int) > 0))"
_P = "r as (select *, row_number() over (partition by doc_id order by page, floor(top / 10), x0, box_id) as place from b)"
_M = "m as (select doc_id, page, avg(bottom - top) as mh, avg((x1 - x0) / greatest(length(text), 1)) as mw from b group by 1, 2)"
_GROUP = "g as (select *, sum(coalesce(opens, true)::int) over (partition by doc_id order by place rows unbounded preceding) as grp from f)"
_Q = lambda s: s.replace("'", "''")
_HAS = lambda c, chars: f"(length({c}) > 0 and contains('{_Q(chars)}', {c}))"
SQL = {
    "boxes_in_order": f"with {_B}, {_P} select box_id, place from r",
    "boxes_merged_vertically": f"""with {_B}, {_P}, {_M}, t as (select *, trim(text) as t, lead(page) over (partition by doc_id order by place) as ahead from r where trim(text) <> ''),
      u as (select t.*, mh, mw from t join m using (doc_id, page) where not (coalesce(ahead > page, false) and regexp_matches(text, '^[0-9  •一—-]+$'))),
      w as (select *, lag(page) over v as p_page, lag(x0) over v as p_x0, lag(x1) over v as p_x1, lag(bottom) over v as p_bottom, lag(layoutno) over v as p_no, lag(t) over v as p_t, lag(mh) over v as p_mh, lag(mw) over v as p_mw from u window v as (partition by doc_id order by place)),
      f as (select *, p_page is null or p_x1 < x0 or p_x0 > x1 or ((layoutno is distinct from p_no or {_HAS('right(p_t, 1)', L.ENDS)} or (page = p_page and top - p_bottom > p_mh * 1.5) or (page <> p_page and abs(x0 - p_x0) > p_mw * 4))
        and not ({_HAS('right(p_t, 1)', L.BINDS_AFTER)} or (length(p_t) > 1 and {_HAS('substr(p_t, -2, 1)', L.BINDS_BEFORE_LAST)}) or {_HAS('left(t, 1)', L.BINDS_NEXT)})) as opens from w),
      {_GROUP} select doc_id, grp::bigint as box_group, arg_min(page, place) as page, min(x0) as x0, max(x1) as x1, count(*) as n_boxes, md5(string_agg(text, '' order by place)) as text_md5 from g group by 1, 2""",
    "boxes_merged_by_bullet": f"""with {_B}, {_P}, t as (select doc_id, place, top, bottom, case when page % 2 = 0 then '• ' else '- ' end || text as text from r),
      w as (select *, left(trim(text), 1) as c, lag(left(trim(text), 1)) over v as p_c, lag(top) over v as p_top from t window v as (partition by doc_id order by place)), f as (select *, p_c is null or p_c <> c or p_top > bottom as opens from w),
      {_GROUP} select doc_id, grp::bigint as box_group, count(*) as n_boxes, md5(string_agg(text, chr(10) order by place)) as text_md5 from g group by 1, 2""",
    "pages_without_leaders": f"with {_B}, t as (select doc_id, page, x0 % 3 = 0 or regexp_matches(text, '··|\\.{{4,}}|…{{2,}}') as led from b) select doc_id, page, count(*) as n from t group by 1, 2 having sum(led::int) <= 1",
    "boxes_without_scraps": f"""with {_B}, {_P}, {_M}, u as (select r.*, mh, coalesce(regexp_matches(text, '^$'), false) or coalesce(layout_type = 'title', false) as head from r join m using (doc_id, page) where coalesce(layout_type, '') <> '' or x1 - x0 > 200 or bottom - top > mh),
      w as (select *, lag(page) over v as p_page, lag(x0) over v as p_x0, lag(x1) over v as p_x1, lag(top) over v as p_top, lag(bottom) over v as p_bottom, lag(head) over v as p_head from u window v as (partition by doc_id order by place)),
      f as (select *, p_page is null or p_page <> page or (not p_head and ((top + bottom - p_top - p_bottom) / 2 >= 3 * mh or greatest(0, x0 - p_x1, p_x0 - x1) >= 60)) as opens from w),
      {_GROUP}, k as (select doc_id, grp from g group by 1, 2 having bool_or(head) or avg(x1 - x0) >= 210 or avg(x1 - x0) > 200) select box_id, grp::bigint as scrap from g join k using (doc_id, grp)""",
    "boxes_with_layout": f"""with {_B}, c as (select * from b where not regexp_matches(text, '{"|".join(L.GARBAGE)}')), g as (select doc_id, page, box_id as region_id, [{", ".join(f"'{k}'" for k in _KINDS)}][(((x0 % 10) + 10) % 10)::int + 1] as kind, x0 - 10 as x0, x1 + 10 as x1, top - 10 as top, bottom + 10 as bottom from b),
      s as (select c.box_id, g.region_id, kind, (least(c.x1, g.x1) - greatest(c.x0, g.x0)) * (least(c.bottom, g.bottom) - greatest(c.top, g.top)) / ((c.x1 - c.x0) * (c.bottom - c.top)) as share from c join g using (doc_id, page) where c.x1 > c.x0 and c.bottom > c.top and least(c.x1, g.x1) > greatest(c.x0, g.x0) and least(c.bottom, g.bottom) > greatest(c.top, g.top)),
      a as (select *, row_number() over (partition by box_id order by list_position([{", ".join(f"'{k}'" for k in L.PRIORITY)}], kind), share desc, region_id) as rn from s where share >= 0.4),
      w as (select c.*, a.region_id as no, a.kind as kind from c left join (select * from a where rn = 1) a using (box_id)),
      d as (select *, coalesce(kind in ('footer', 'header', 'reference') and not ((kind = 'footer' and bottom < 720) or (kind = 'header' and top > 80)), false) as gone from w),
      tw as (select doc_id, trim(text) as t from d where gone group by doc_id, kind, trim(text) having count(*) > 1)
      select box_id, case when kind = 'equation' then 'figure' else coalesce(kind, '') end as layout_type, no as layoutno from d where not gone and not exists (select 1 from tw where tw.doc_id = d.doc_id and tw.t = trim(d.text))""",
    "tables_assembled": "with l as (select distinct on (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_quantity::int as q from lineitem where l_orderkey is not null), x as (select *, case when l_linenumber = 1 then 'th' else 'td' end as t from l) select l_orderkey as table_id, count(*) as n_rows, 3::bigint as n_cols, md5('<table>' || string_agg('<tr><' || t || '>' || l_linenumber || '</' || t || '><' || t || '>' || l_partkey || '</' || t || '><' || t || '>' || q || '</' || t || '></tr>', '' order by l_linenumber) || '</table>') as html_md5 from x group by 1",
}
