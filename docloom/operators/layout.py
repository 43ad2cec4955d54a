"""Text boxes of pages: reading order, merging, page filters, layout classes, tables.

``boxes``: doc_id, page, box_id, x0, x1, top, bottom, text and, where a stage needs it, layout_type and layoutno. Coordinates are numbers;
boxes with a null coordinate take no part in geometry and are kept as they are unless said otherwise. Windows run per document and page,
or per document where a stage crosses pages, and spill; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.tabular import overlaps

#: Marks at the end or beginning of a line that bind it to its neighbour, and those that end a sentence.
BINDS_AFTER = ",;:'\"，、‘“；：-"
BINDS_BEFORE_LAST = ",;:'\"，‘“、；："
BINDS_NEXT = "。；？！?”）),，、："
ENDS, ENDS_ENGLISH = "。？！?", ".!?"
#: Texts that are no content.
GARBAGE = [r"^•+$", r"^[0-9]{1,2} / ?[0-9]{1,2}$", r"^[0-9]{1,2} of [0-9]{1,2}$", r"^http://[^ ]{12,}", r"\(cid *: *[0-9]+ *\)"]
#: Layout classes in the order in which they claim a box, and those whose text is dropped.
PRIORITY = ["footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation"]
DROPPED = ["footer", "header", "reference"]


def _in(c: Column, chars: str) -> Column:
    return F.coalesce((F.instr(F.lit(chars), c) > 0) & (F.length(c) > 0), F.lit(False))


def page_means(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, mean_height, mean_width): of the boxes of a page, and of one of their characters."""
    wide = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    return boxes.groupBy("doc_id", "page").agg(F.avg(F.col("bottom") - F.col("top")).alias("mean_height"), F.avg(wide).alias("mean_width"))


def in_reading_order(boxes: DataFrame, tolerance: float = 3.0, across: bool = False) -> DataFrame:
    """Add ``place``, from 1 on in a document: by page, then rows of ``tolerance`` units of height, then from left to right; with ``across``
    columns of ``tolerance`` units first. Ties go to the smaller box_id."""
    row, column = F.floor(F.col("top") / tolerance), F.floor(F.col("x0") / tolerance)
    keys = [column, F.col("top")] if across else [row, F.col("x0")]
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", *keys, "box_id")))


def _merged(rows: DataFrame, opens: Column, separator: str) -> DataFrame:
    """(doc_id, group, page, x0, x1, top, bottom, n_boxes, text): neighbours between opening rows, in order of place."""
    upto = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("_open", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("group", F.sum("_open").over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), separator)
    return grouped.groupBy("doc_id", "group").agg(F.min_by("page", "place").alias("page"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("top", "place").alias("top"), F.max_by("bottom", "place").alias("bottom"), F.count("*").alias("n_boxes"), text.alias("text"))


def merged_vertically(boxes: DataFrame, english: bool = False) -> DataFrame:
    """Lines to paragraphs (see ``_merged``): a box goes on from the one before unless a feature forbids it.

    It begins anew beside the one before, with no overlap in width; and where the layout changes, a sentence ended, a gap of one and a
    half lines opens, or the margin moves by four characters at a new page, unless a mark binds the two. Blank boxes, and
    page numbers at the end of a page, are dropped. ``boxes`` need ``place`` and layoutno.
    """
    order = Window.partitionBy("doc_id").orderBy("place")
    rows = boxes.withColumn("_t", F.trim("text")).where("_t <> ''").withColumn("_ahead", F.lead("page").over(order))
    rows = rows.where(~(F.coalesce(F.col("_ahead") > F.col("page"), F.lit(False)) & F.col("text").rlike("^[0-9  •一—-]+$")))
    rows = rows.join(page_means(boxes), ["doc_id", "page"])
    before = rows.withColumn("_p", F.lag(F.struct("page", "x0", "x1", "bottom", "layoutno", "_t", "mean_height", "mean_width")).over(order))
    last = F.substring("_p._t", -1, 1)
    binds = _in(last, BINDS_AFTER) | (_in(F.substring("_p._t", -2, 1), BINDS_BEFORE_LAST) & (F.length("_p._t") > 1)) | _in(F.substring("_t", 1, 1), BINDS_NEXT)
    same = F.col("page") == F.col("_p.page")
    parts = (
        ~F.col("layoutno").eqNullSafe(F.col("_p.layoutno")) | _in(last, ENDS) | (F.lit(english) & _in(last, ENDS_ENGLISH))
        | (same & (F.col("top") - F.col("_p.bottom") > F.col("_p.mean_height") * 1.5)) | (~same & (F.abs(F.col("x0") - F.col("_p.x0")) > F.col("_p.mean_width") * 4))
    )
    beside = (F.col("_p.x1") < F.col("x0")) | (F.col("_p.x0") > F.col("x1"))
    return _merged(before, F.col("_p").isNull() | beside | (parts & ~binds), "")


def merged_by_bullet(boxes: DataFrame) -> DataFrame:
    """Neighbours that begin with the same symbol become one, line by line (see ``_merged``). Letters (but h and i) and ideographs are
    no symbols; a box that lies above the one before begins anew. Blank boxes are dropped. ``boxes`` need ``place``."""
    order = Window.partitionBy("doc_id").orderBy("place")
    rows = boxes.withColumn("_c", F.substring(F.trim("text"), 1, 1)).where("_c <> ''")
    rows = rows.withColumn("_p", F.lag(F.struct("_c", "top")).over(order))
    symbol = ~F.lower(F.col("_c")).rlike("[a-gj-z]") & ~F.col("_c").rlike("[一-鿿]")
    return _merged(rows, F.col("_p").isNull() | (F.col("_p._c") != F.col("_c")) | ~symbol | (F.col("_p.top") > F.col("bottom")), "\n")


def without_leader_pages(boxes: DataFrame, most: int = 3) -> DataFrame:
    """Drop pages with more than ``most`` boxes that hold dot leaders: tables of contents that no heading announces."""
    dirty = boxes.where(F.col("text").rlike("··|\\.{4,}|…{2,}")).groupBy("doc_id", "page").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return boxes.join(dirty.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def without_scraps(boxes: DataFrame, page_width: float, pattern: str = "^$") -> DataFrame:
    """Add ``scrap`` (chains of boxes) and keep those worth it: a chain with a title or a text like ``pattern``, or of a mean width of 35 % of the page or of more than 200.

    A box is useful with a layout class, above a third of the page's width, or higher than the page's mean; the others are dropped. A chain goes on to the next
    useful box of the page that is within three mean heights below and a tenth of the page's width beside.
    """
    order = Window.partitionBy("doc_id").orderBy("place")
    wide, high = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    rows = boxes.join(page_means(boxes), ["doc_id", "page"])
    rows = rows.where((F.coalesce(F.col("layout_type"), F.lit("")) != "") | (wide > page_width / 3) | (high > F.col("mean_height")))
    rows = rows.withColumn("_head", F.coalesce(F.col("text").rlike(pattern), F.lit(False)) | F.coalesce(F.col("layout_type") == "title", F.lit(False)))
    rows = rows.withColumn("_p", F.lag(F.struct("page", "x0", "x1", "top", "bottom", "_head")).over(order))
    down = (F.col("top") + F.col("bottom") - F.col("_p.top") - F.col("_p.bottom")) / 2
    beside = F.greatest(F.lit(0.0), F.greatest(F.col("x0") - F.col("_p.x1"), F.col("_p.x0") - F.col("x1")))
    opens = F.col("_p").isNull() | (F.col("_p.page") != F.col("page")) | (~F.col("_p._head") & ((down >= 3 * F.col("mean_height")) | (beside >= page_width / 10)))
    rows = rows.withColumn("scrap", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.groupBy("doc_id", "scrap").agg(F.avg(wide).alias("_w"), F.max("_head").alias("_h")).where(F.col("_h") | (F.col("_w") >= 0.35 * page_width) | (F.col("_w") > 200))
    return rows.join(kept.select("doc_id", "scrap"), ["doc_id", "scrap"], "left_semi").drop("_p", "_head", "mean_height", "mean_width")


def with_layout(boxes: DataFrame, regions: DataFrame, page_height: float, least: float = 0.4) -> DataFrame:
    """Boxes with layout_type and layoutno, by the regions (doc_id, page, region_id, kind, x0, x1, top, bottom) they lie in.

    The first class of PRIORITY that covers ``least`` of a box claims it, its best region first; equations count as figures; boxes in none
    have an empty class. Garbage texts are dropped. So is what lies in headers, footers and references, save a footer above
    the last tenth of a page and a header below the first; a text that is dropped there more than once is dropped everywhere.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PRIORITY) for x in (k, i)])
    clean = boxes.drop("layoutno", "layout_type").where(~F.coalesce(F.col("text"), F.lit("")).rlike("|".join(GARBAGE)))
    where = lambda df: df.withColumn("page", F.struct("doc_id", "page"))
    shares = overlaps(where(clean), where(regions), least)
    claims = shares.join(regions.select("region_id", "kind"), "region_id").withColumn("_o", F.try_element_at(order, "kind")).where("_o is not null")
    best = claims.groupBy("box_id").agg(F.min(F.struct("_o", (-F.col("share")).alias("s"), "region_id", "kind")).alias("_b")).select("box_id", F.col("_b.region_id").alias("layoutno"), F.col("_b.kind").alias("_kind"))
    rows = clean.join(best, "box_id", "left")
    stays = ((F.col("_kind") == "footer") & (F.col("bottom") < 0.9 * page_height)) | ((F.col("_kind") == "header") & (F.col("top") > 0.1 * page_height))
    gone = F.coalesce(F.col("_kind").isin(DROPPED) & ~stays, F.lit(False))
    twice = rows.where(gone).groupBy("doc_id", "_kind", F.trim("text").alias("_t")).agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", "_t").distinct()
    kept = rows.where(~gone).withColumn("_t", F.trim("text")).join(twice, ["doc_id", "_t"], "left_anti")
    kind = F.when(F.col("_kind") == "equation", "figure").otherwise(F.coalesce("_kind", F.lit("")))
    return kept.withColumn("layout_type", kind).drop("_t", "_kind")


def assembled_tables(cells: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """cells (table_id, box_id, x0, top, text, row_no, col_no, header) -> (table_id, n_rows, n_cols, html).

    Rows and columns are those a recogniser numbered; a cell without a number goes to the row or column of its place, by ``tolerance`` units. Numbers are made dense;
    several boxes of a cell stand in reading order, joined by blanks; a row with a header cell is a header row. Null texts are blank.
    """
    dense = lambda c: F.dense_rank().over(Window.partitionBy("table_id").orderBy(c))
    rows = cells.withColumn("_r", F.coalesce(F.col("row_no").cast("double") * 1e6, F.floor(F.col("top") / tolerance).cast("double")))
    rows = rows.withColumn("_c", F.coalesce(F.col("col_no").cast("double") * 1e6, F.floor(F.col("x0") / tolerance).cast("double")))
    rows = rows.withColumn("r", dense(F.col("_r"))).withColumn("c", dense(F.col("_c")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "box_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    grid = rows.groupBy("table_id", "r", "c").agg(F.trim(text).alias("t"), F.max(F.coalesce("header", F.lit(False))).alias("h"))
    size = grid.groupBy("table_id").agg(F.max("r").alias("n_rows"), F.max("c").alias("n_cols"))
    line = grid.groupBy("table_id", "r").agg(F.max("h").alias("h"), F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("m")).join(size, "table_id")
    tag = F.when(F.col("h"), "th").otherwise("td")
    cell = lambda i: F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce(F.try_element_at("m", i), F.lit("")), F.lit("</"), tag, F.lit(">"))
    html = F.concat(F.lit("<tr>"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_cols")), cell), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", html.alias("x")))), lambda x: x["x"]), "")
    return line.groupBy("table_id", "n_rows", "n_cols").agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))
