"""Tables: column typing, rows as chunks, HTML blocks, cell classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.lexical import tokens
from docloom.runtime import materialize, numbered, release

INT, FLOAT, BOOL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?[0-9]*\.?[0-9]+$", r"(?i)^(true|yes|false|no|是|否|✓|×)$"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9:.]+)?$"
#: Suffix of a typed column.
SUFFIX = {"int": "_long", "float": "_flt", "text": "_tks", "datetime": "_dt", "bool": "_kwd"}


def cell_kind(cell: Column) -> Column:
    c = F.trim(cell.cast("string"))
    return F.when(c.isNull() | (c == ""), None).when(c.rlike(BOOL), "bool").when(c.rlike(INT), "int").when(c.rlike(FLOAT), "float").when(c.rlike(DATE), "datetime").otherwise("text")


def column_types(df: DataFrame) -> DataFrame:
    """(column, kind, n): the kind that most cells of a column have; ties by name; integers beside floats are floats."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cell_kind(F.col(c)).alias("kind")) for c in df.columns])).alias("e")).select("e.column", "e.kind").where("kind is not null")
    n = cells.groupBy("column", "kind").agg(F.count("*").alias("n"))
    best = n.groupBy("column").agg(F.max(F.struct("n", "kind")).alias("b"), F.max(F.when(F.col("kind") == "float", F.col("n"))).alias("_f"))
    kind = F.when((F.col("b.kind") == "int") & (F.col("_f") > 0), "float").otherwise(F.col("b.kind"))
    return best.select("column", kind.alias("kind"), F.col("b.n").alias("n"))


def typed(cell: Column, kind: str) -> Column:
    """Cast to the column's kind; what does not fit becomes null."""
    c = F.trim(cell.cast("string"))
    if kind == "int":
        return c.try_cast("bigint")
    if kind == "float":
        return c.try_cast("double")
    if kind == "datetime":
        return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    if kind == "bool":
        return F.when(c.rlike(r"(?i)^(true|yes|是|✓)$"), "yes").when(c.rlike(r"(?i)^(false|no|否|×)$"), "no")
    return c


def rows_to_chunks(df: DataFrame, key: str, drop: tuple[str, ...] = (), joint: str = "; ") -> DataFrame:
    """(key, text): one chunk per row, 'column: value' joined by ``joint``; null and blank cells are left out."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column name")
    cols = [c for c in df.columns if c != key and c not in drop]
    parts = F.filter(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols]), lambda x: x.isNotNull())
    return df.select(key, F.array_join(parts, joint).alias("text")).where("text <> ''")


def html_blocks(df: DataFrame, order: str, size: int, *columns: str, within: str | None = None) -> DataFrame:
    """(within, block, html): a table per ``size`` rows, each with the header. Without ``within`` all rows are one table, numbered by many tasks."""
    keys = [within] if within else []
    cell = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in columns])
    placed = df.withColumn("_rn", F.row_number().over(Window.partitionBy(within).orderBy(order))) if within else numbered(df, order, name="_rn")
    rows = placed.withColumn("block", F.floor((F.col("_rn") - 1) / size)).withColumn("_row", F.concat(F.lit("<tr>"), cell, F.lit("</tr>")))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_row"))), lambda x: x["_row"]), "")
    return rows.groupBy(*keys, "block").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


#: Rows to a block by the number of columns: (columns up to, most rows, least rows, parts of the table).
BLOCK_ROWS = [(3, 20, 8, 3), (8, 15, 6, 4), (1 << 30, 12, 4, 5)]


def block_rows(n_rows: Column, n_columns: int) -> Column:
    """Rows to a block: a part of the table, within bounds that fall with the number of its columns; 12 for tables without rows."""
    _, most, least, parts = next(x for x in BLOCK_ROWS if n_columns <= x[0])
    return F.when(n_rows < 1, F.lit(12)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n_rows / parts)))).cast("int")


def filled_down(df: DataFrame, within: str, order: str, *columns: str) -> DataFrame:
    """Merged cells: a blank cell takes the last value above it in its table."""
    w = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})


def adaptive_blocks(df: DataFrame, within: str, order: str, *columns: str) -> DataFrame:
    """(within, block, n_rows, html): tables in blocks of a size that suits them, each with the header. Rows without any value are skipped."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    some = df.where(F.concat(*[text(c) for c in columns]) != "")
    sizes = some.groupBy(within).agg(block_rows(F.count("*"), len(columns)).alias("_size"))
    rows = some.withColumn("_rn", F.row_number().over(Window.partitionBy(within).orderBy(order))).join(sizes, within).withColumn("block", F.floor((F.col("_rn") - 1) / F.col("_size")))
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), text(c), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", cells.alias("r")))), lambda x: x["r"]), "")
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return rows.groupBy(within, "block").agg(F.count("*").alias("n_rows"), F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


#: Patterns of a cell's text and its class; the first that fits holds.
CELL_CLASSES = [
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
]


def block_type(text: Column, person: Column | None = None) -> Column:
    """Class of a table cell: date, number, code, English, number with unit, single character; else by its tokens of two or more
    characters: four to eleven are a text (Tx), twelve and more a long one (Lx), a single one that is a ``person`` (a caller's test) a name
    (Nr), and anything else other (Ot). Null is other."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.size(F.filter(tokens(t), lambda w: F.length(w) > 1))
    out = None
    for pattern, kind in CELL_CLASSES:
        out = F.when(t.rlike(pattern), kind) if out is None else out.when(t.rlike(pattern), kind)
    out = out.when(n >= 12, "Lx").when(n > 3, "Tx")
    return (out if person is None else out.when((n == 1) & person, "Nr")).otherwise("Ot")


def overlaps(boxes: DataFrame, regions: DataFrame, least: float, cell: int = 256) -> DataFrame:
    """(box_id, region_id, share): share of a box's area that lies in a region of its page, from ``least`` on.

    Theta join on a grid: both sides go to the cells of ``cell`` units they touch and meet there, so the work per
    page is local; each pair is kept once, in the cell of its overlap's corner. Empty boxes have no share.
    """
    grid = lambda df: df.withColumn("_x", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("_y", F.explode(F.sequence(F.floor(F.col("top") / cell), F.floor(F.col("bottom") / cell))))
    a = grid(boxes.where("x1 > x0 and bottom > top"))
    b = grid(regions.where("x1 > x0 and bottom > top")).select("page", "_x", "_y", "region_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "top", "bottom")])
    left, upper = F.greatest("x0", "r_x0"), F.greatest("top", "r_top")
    w, h = F.least("x1", "r_x1") - left, F.least("bottom", "r_bottom") - upper
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    j = a.join(b, ["page", "_x", "_y"]).where((w > 0) & (h > 0) & (F.col("_x") == F.floor(left / cell)) & (F.col("_y") == F.floor(upper / cell)))
    return j.select("box_id", "region_id", (w * h / area).alias("share")).where(F.col("share") >= least)


def non_max(boxes: DataFrame, most: float = 0.2, least: float = 0.0, cell: int = 64, local: int = 200_000) -> DataFrame:
    """Greedy suppression per page and class: by falling score, boxes whose overlap with a kept one is below ``most`` (0 to 1, not 0).

    box_id is unique per page and class; ties of score fall to the smaller. Of equal boxes the first stands for all, since what
    removes it removes them. Overlapping pairs meet on a grid of ``cell`` units; a round keeps what no undecided better box
    overlaps and removes what those overlap, which is the greedy result. The last ``local`` pairs are settled on the driver.
    Boxes without area or with a null coordinate overlap nothing.
    """
    spark, sides = boxes.sparkSession, ["x0", "x1", "top", "bottom"]
    scored = materialize(boxes.where(F.col("score") > least))
    keyed = scored.withColumn("_k", F.struct("page", "kind"))
    solid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("bottom") > F.col("top")), F.lit(False))
    first = keyed.where(solid).groupBy("_k", *sides).agg(F.min(F.struct((-F.col("score")).alias("s"), "box_id")).alias("_p"))
    first = materialize(first.withColumn("_i", F.monotonically_increasing_id()))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    grid = first.withColumn("_x", cells("x0", "x1")).withColumn("_y", cells("top", "bottom"))
    other = grid.select("_k", "_x", "_y", F.col("_i").alias("lo"), F.col("_p").alias("_q"), *[F.col(c).alias(f"r_{c}") for c in sides])
    left, upper = F.greatest("x0", "r_x0"), F.greatest("top", "r_top")
    w, h = F.least("x1", "r_x1") - left, F.least("bottom", "r_bottom") - upper
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")) + (F.col("r_x1") - F.col("r_x0")) * (F.col("r_bottom") - F.col("r_top"))
    met = grid.join(other, ["_k", "_x", "_y"]).where((F.col("_p") < F.col("_q")) & (w > 0) & (h > 0) & (F.col("_x") == F.floor(left / cell)) & (F.col("_y") == F.floor(upper / cell)))
    pairs = materialize(met.where(w * h / (area - w * h) >= most).select(F.col("_i").alias("hi"), "lo"))
    removed = spark.createDataFrame([], "lo long")
    while pairs.count() > local:
        better = pairs.select("hi").distinct().join(pairs.select(F.col("lo").alias("hi")), "hi", "left_anti")
        gone = materialize(pairs.join(better, "hi", "left_semi").select("lo").distinct())
        rest = pairs.join(better, "hi", "left_anti").join(gone.select(F.col("lo").alias("hi")), "hi", "left_anti").join(gone, "lo", "left_anti")
        rest = materialize(rest.select("hi", "lo"))
        release(pairs)
        pairs, removed = rest, removed.unionByName(gone)
    removed = removed.unionByName(spark.createDataFrame([(i,) for i in _suppressed(pairs.collect())], "lo long"))
    stay = first.join(removed, F.col("_i") == F.col("lo"), "left_anti").select("_k", F.col("_p.box_id").alias("box_id"))
    return keyed.where(solid).join(stay, ["_k", "box_id"], "left_semi").unionByName(keyed.where(~solid)).select(*boxes.columns)


def _suppressed(pairs: list) -> set:
    """What greedy order removes, of pairs (better, worse)."""
    under: dict = {}
    open_: dict = {}
    for hi, lo in pairs:
        under.setdefault(hi, []).append(lo)
        open_[lo] = open_.get(lo, 0) + 1
    ready, gone = [i for i in under if i not in open_], set()
    while ready:
        i = ready.pop()
        for lo in under.get(i, ()):
            if i not in gone:
                gone.add(lo)
            open_[lo] -= 1
            if open_[lo] == 0:
                ready.append(lo)
    return gone


def merged_horizontally(boxes: DataFrame) -> DataFrame:
    """Neighbours of one layout region on about one line become one box: a gap-and-island window in reading order."""
    w = Window.partitionBy("page", "layout").orderBy("top", "x0", "box_id")
    height = (F.col("bottom") - F.col("top") + F.lag("bottom").over(w) - F.lag("top").over(w)) / 2
    apart = F.lag("top").over(w).isNull() | (F.abs(F.col("top") - F.lag("top").over(w)) >= height / 3) | F.col("layout").rlike("^(table|figure|equation)")
    groups = boxes.withColumn("_o", apart.cast("int")).withColumn("_g", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "box_id", "text"))), lambda x: x["text"]), " ")
    return groups.groupBy("page", "layout", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), text.alias("text")).drop("_g")
