"""Chunkers that compose the simpler ones: sections under their headings, manuals, laws and books, questions, tags, rows.

``rows``: doc_id, pos, text and, where named, level (place of a heading mark in its family, from 0; null for plain lines).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions.text import token_count
from docloom.operators import chunking as C

#: Beginnings of questions.
QUESTIONS = [
    r"第([零一二三四五六七八九十百0-9]+)问",
    r"第([零一二三四五六七八九十百0-9]+)条",
    r"[\(（]([零一二三四五六七八九十百]+)[\)）]",
    r"第([0-9]+)问",
    r"第([0-9]+)条",
    r"([0-9]{1,2})[\. 、]",
    r"([零一二三四五六七八九十百]+)[ 、]",
    r"[\(（]([0-9]{1,2})[\)）]",
    r"QUESTION (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
    r"QUESTION (I+V?|VI*|XI|IX|X)",
    r"QUESTION ([0-9]+)",
]
#: Tokens under which lone sections are put together, and the bounds of a manual's sections.
LONE, SMALL, LARGE = 218, 32, 1024


def question_votes(rows: DataFrame) -> DataFrame:
    """(doc_id, pattern): the first of QUESTIONS that any line begins with; -1 where none does. Each pattern counts once, so the first wins."""
    t = F.trim("text")
    some = [F.max(F.coalesce(t.rlike(f"^(?:{p})") & ~t.rlike(C.NO_BULLET), F.lit(False))) for p in QUESTIONS]
    found = rows.groupBy("doc_id").agg(F.array(*some).alias("_f"))
    return found.select("doc_id", (F.array_position("_f", True) - 1).cast("int").alias("pattern"))


def question_sections(rows: DataFrame) -> DataFrame:
    """(doc_id, group, question, answer): a line with the document's question mark opens a question; its later lines are the answer."""
    votes = question_votes(rows).where("pattern >= 0")
    each = None
    for i, p in enumerate(QUESTIONS):
        hit = (F.col("pattern") == i) & F.trim("text").rlike(f"^(?:{p})") & ~F.trim("text").rlike(C.NO_BULLET)
        each = hit if each is None else each | hit
    marked = C.opened_by(rows.join(votes, "doc_id").withColumn("_q", F.coalesce(each, F.lit(False))), F.col("_q")).where("group > 0")
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_q"), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return marked.groupBy("doc_id", "group").agg(F.max(F.when(F.col("_q"), F.col("text"))).alias("question"), answer.alias("answer"))


def sections_under_headings(rows: DataFrame, levels: int = 6, depth: int = 5) -> DataFrame:
    """(doc_id, pos, path, text, lone): every plain line below its nearest headings, the highest first, and every heading of the lowest ``depth - 1`` levels
    below which no section stands.

    Blank lines, lines of one character and bare numbers take no part. ``lone``: without a heading above.
    """
    kept = rows.where((F.length(F.trim("text")) > 1) & ~F.trim("text").rlike("^[0-9]+$"))
    placed = C.nearest_parents(kept, levels)
    plain = placed.where("level is null")
    low = placed.where((F.col("level") >= levels + 1 - depth) & F.col("level").isNotNull())
    used = placed.select("doc_id", F.explode("parents").alias("pos")).distinct()
    every = plain.unionByName(low.join(used, ["doc_id", "pos"], "left_anti"))
    heads = kept.where("level is not null").select("doc_id", F.col("pos").alias("_h"), F.col("text").alias("_t"))
    above = every.select("doc_id", "pos", F.explode("parents").alias("_h")).join(heads, ["doc_id", "_h"])
    paths = above.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_h", "_t"))), lambda x: x["_t"]), "\n").alias("path"))
    out = every.join(paths, ["doc_id", "pos"], "left")
    return out.select("doc_id", "pos", "level", F.coalesce("path", F.lit("")).alias("path"), "text", F.col("path").isNull().alias("lone"))


def hierarchical_merge(rows: DataFrame, levels: int = 6, depth: int = 5, budget: int = LONE) -> DataFrame:
    """(doc_id, chunk_no, text): each section with its headings is a chunk; neighbouring lone sections are put together below ``budget`` tokens.

    Plain lines come first, in order, then lone headings from the lowest level up. The fold runs over the sections of one document in
    an Arrow batch; a document is one row of text to begin with.
    """
    rank = F.struct(F.coalesce(-F.col("level"), F.lit(-levels - 1)).alias("a"), F.col("pos").alias("b"))
    whole = F.when(F.col("lone"), F.col("text")).otherwise(F.concat("path", F.lit("\n"), "text"))
    listed = sections_under_headings(rows, levels, depth).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("o"), "lone", token_count("text").alias("n"), whole.alias("t")))).alias("s"))

    def fold(sections: list[dict]) -> list[str]:
        out: list[list[str]] = [[]]
        size = 0
        for s in sections:
            if s["lone"] and s["n"] + size < budget:
                out[-1].append(s["t"])
                size += s["n"]
            else:
                out.append([s["t"]])
                size = s["n"] if s["lone"] else budget
        return ["\n".join(x) for x in out if x]

    return _per_document(listed, fold)


def _per_document(listed: DataFrame, fold: Callable[[list[dict]], list[str]]) -> DataFrame:
    kind = listed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, nos, texts = [], [], []
            for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, t in enumerate(fold(s)):
                    ids.append(d)
                    nos.append(k)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_no", "text"])

    return listed.select("doc_id", "s").mapInArrow(run, f"doc_id {kind}, chunk_no int, text string")


def manual_sections(rows: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """(doc_id, chunk_no, text): sections between titles of the pivot level; a line joins the chunk before while that has below ``small`` tokens, or below
    ``large`` in the same section. ``rows`` need level."""
    pivot = C.title_level(rows)
    w = Window.partitionBy("doc_id").orderBy("pos")
    leveled = rows.join(pivot.withColumnRenamed("level", "_m"), "doc_id", "left").withColumn("_l", F.coalesce("level", F.lit(99)))
    opens = (F.col("_l") <= F.coalesce("_m", F.lit(-1))) & (F.lag("_l").over(w) != F.col("_l"))
    listed = C.opened_by(leveled, opens).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("group").alias("g"), token_count("text").alias("n"), F.coalesce("text", F.lit("")).alias("t")))).alias("s"))

    def fold(lines: list[dict]) -> list[str]:
        out: list[list[str]] = []
        last, size = -2, 0
        for x in lines:
            if out and (size < small or (size < large and x["g"] == last)):
                out[-1].append(x["t"])
                size += x["n"]
            else:
                out.append([x["t"]])
                size, last = x["n"], x["g"]
        return ["\n".join(x) for x in out]

    return _per_document(listed, fold)


def law_or_book(rows: DataFrame, budget: int = 256) -> DataFrame:
    """(doc_id, chunk_no, text): contents removed; documents with a family of heading marks go by ``hierarchical_merge`` in that family, the others
    by ``naive_merge`` (books)."""
    lines = C.without_contents(rows)
    family = C.bullet_votes(lines).select("doc_id", "family")
    out = None
    for i, marks in enumerate(C.BULLETS):
        mine = lines.join(family.where(F.col("family") == i), "doc_id", "left_semi")
        part = hierarchical_merge(C.with_levels(mine, i), len(marks))
        out = part if out is None else out.unionByName(part)
    rest = lines.join(family.where("family < 0"), "doc_id", "left_semi").withColumn("group", F.lit(0))
    return out.unionByName(C.naive_merge(C.grouped_text(rest).select("doc_id", "text"), budget))


def pairs_from_cells(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, question, answer): the first two cells of a row that are not blank; rows with fewer are dropped."""
    cells = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in columns]), lambda x: x.isNotNull() & (x != ""))
    return rows.select(key, cells.alias("_c")).where(F.size("_c") >= 2).select(key, F.get("_c", F.lit(0)).alias("question"), F.get("_c", F.lit(1)).alias("answer"))


def tagged(rows: DataFrame, content: str, tags: str) -> DataFrame:
    """Add ``tag_kwd``: the tags of a comma-separated field, trimmed, dots as underscores, blank ones dropped; rows without content are dropped."""
    parts = F.transform(F.split(F.coalesce(F.col(tags), F.lit("")), ","), lambda t: F.replace(F.trim(t), F.lit("."), F.lit("_")))
    return rows.where(F.trim(F.col(content)) != "").withColumn("tag_kwd", F.filter(parts, lambda t: t != ""))


def row_batches(rows: DataFrame, text: str, order: str, *within: str, size: int = 10, english: bool = True) -> DataFrame:
    """(within, batch, text): rows of a table put together ``size`` at a time, with '; ' or its ideographic form between them."""
    n = F.row_number().over(Window.partitionBy(*within).orderBy(order))
    cut = rows.withColumn("_n", n).withColumn("batch", F.floor((F.col("_n") - 1) / size))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "; " if english else "； ")
    return cut.groupBy(*within, "batch").agg(body.alias("text"))


def tokenised(chunks: DataFrame, text: str, fine: Callable[[Column], Column] = lambda words: words) -> DataFrame:
    """Add content_ltks and content_sm_ltks: tokens of the text without table tags, and their finer pieces. Blank chunks are dropped."""
    words = L.tokens(L.without_table_tags(text))
    return chunks.where(F.trim(F.col(text)) != "").withColumn("content_ltks", F.array_join(words, " ")).withColumn("content_sm_ltks", F.array_join(fine(words), " "))


def merged_with_images(rows: DataFrame, budget: int = 128) -> DataFrame:
    """(doc_id, chunk, text, images): lines in order until the budget is exceeded, with the references of the images they bring; nothing overlaps.

    ``rows``: doc_id, pos, text, image. A chunk is closed by the line that takes it above the budget.
    """
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", token_count("text").alias("n"), F.coalesce("text", F.lit("")).alias("t"), "image"))).alias("s"))
    step = lambda a, x: F.struct((F.when(a["size"] > budget, F.lit(0)).otherwise(a["size"]) + x["n"]).alias("size"), F.when(a["size"] > budget, a["chunk"] + 1).otherwise(a["chunk"]).alias("chunk"), F.array_append(a["to"], F.when(a["size"] > budget, a["chunk"] + 1).otherwise(a["chunk"])).alias("to"))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("to"))
    to = F.aggregate("s", start, step, lambda a: a["to"])
    flat = listed.select("doc_id", F.explode(F.arrays_zip(F.col("s"), to.alias("to"))).alias("e")).select("doc_id", F.col("e.to").alias("chunk"), "e.s.pos", "e.s.t", "e.s.image")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n")
    images = F.transform(F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("pos", "image")))), lambda x: x["image"])
    return flat.groupBy("doc_id", "chunk").agg(text.alias("text"), images.alias("images"))
