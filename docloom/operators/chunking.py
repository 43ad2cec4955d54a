"""Chunkers: ordered text to chunk rows.

Relational ones (markers open groups) are windows over lines; budget folds run per document inside Arrow batches,
each on one document at a time. ``sections``: doc_id, pos, text and what else a chunker names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.lexical import delimiter_pattern

#: Families of heading marks, from the highest level to the lowest.
BULLETS = [
    [r"第[零一二三四五六七八九十百0-9]+(分?编|部分)", r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"第[零一二三四五六七八九十百0-9]+条", r"[\(（][零一二三四五六七八九十百]+[\)）]"],
    [r"第[0-9]+章", r"第[0-9]+节", r"[0-9]{1,2}[\. 、]", r"[0-9]{1,2}\.[0-9]{1,2}[^a-zA-Z/%~-]", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}"],
    [r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"[零一二三四五六七八九十百]+[ 、]", r"[\(（][零一二三四五六七八九十百]+[\)）]", r"[\(（][0-9]{1,2}[\)）]"],
    [r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"Chapter (I+V?|VI*|XI|IX|X)", r"Section [0-9]+", r"Article [0-9]+"],
]
#: Beginnings that look like a mark and are none.
NO_BULLETS = [r"0", r"[0-9]+ +[0-9~个只-]", r"[0-9]+\.{2,}"]
NO_BULLET = "^(" + "|".join(NO_BULLETS) + ")"
MARKDOWN_HEADING = r"^(#{1,6}) "


def lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, text): the lines of each document, in order. Null texts have none."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "text"))


def _in_order(texts: Column, by: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), texts.alias("t")))), lambda x: x["t"]), separator)


def opened_by(rows: DataFrame, opens: Column) -> DataFrame:
    """Add ``group``: the number of opening rows so far in the document; rows before the first are group 0."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w))


def grouped_text(rows: DataFrame, separator: str = "\n") -> DataFrame:
    return rows.groupBy("doc_id", "group").agg(_in_order(F.col("text"), F.col("pos"), separator).alias("text"), F.min("pos").alias("pos"))


def strict_regex(df: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A new chunk at every line that starts with the pattern; blank chunks disappear."""
    return grouped_text(opened_by(lines(df, doc_id, text), F.col("text").rlike(rf"^\s*(?:{pattern})"))).where("trim(text) <> ''")


def qa_pairs(rows: DataFrame, delimiter: str = "\t") -> DataFrame:
    """(doc_id, group, question, answer): a line of two fields opens a pair, other lines extend its answer."""
    parts = F.split("text", re.escape(delimiter))
    pair = F.size(parts) == 2
    grouped = opened_by(rows, pair).where("group > 0")
    first = F.when(pair, F.get(parts, F.lit(0)))
    body = F.when(pair, F.get(parts, F.lit(1))).otherwise(F.col("text"))
    return grouped.groupBy("doc_id", "group").agg(F.first(first, ignorenulls=True).alias("question"), _in_order(body, F.col("pos")).alias("answer"))


def bullet_votes(rows: DataFrame) -> DataFrame:
    """(doc_id, family, n): the family of heading marks that most sections begin with; -1 where none does."""
    t = F.trim("text")
    ok = ~t.rlike(NO_BULLET)
    votes = rows.groupBy("doc_id").agg(*[F.sum(F.coalesce(ok & t.rlike("^(?:" + "|".join(f) + ")"), F.lit(False)).cast("int")).alias(f"_{i}") for i, f in enumerate(BULLETS)])
    best = F.greatest(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(BULLETS))])
    return votes.select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.n") > 0, -F.col("b.i")).otherwise(F.lit(-1)).alias("family"), F.col("b.n").alias("n"))


def with_levels(rows: DataFrame, family: int) -> DataFrame:
    """Add ``level``: place of the first matching mark of a family (from 0); null for plain text."""
    t, out = F.trim("text"), None
    for i, p in enumerate(BULLETS[family]):
        cond = t.rlike(f"^(?:{p})") & ~t.rlike(NO_BULLET)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return rows.withColumn("level", out)


def title_level(rows: DataFrame) -> DataFrame:
    """(doc_id, level): the most frequent level of a document, of equals the highest."""
    n = rows.where("level is not null").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("level")).alias("l"))).alias("m")).select("doc_id", (-F.col("m.l")).alias("level"))


def pivot_sections(rows: DataFrame, pivot: Column) -> DataFrame:
    """Sections that begin where the level reaches the pivot and differs from the one before."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = (F.col("level") <= pivot) & ~F.lag("level").over(w).eqNullSafe(F.col("level"))
    return grouped_text(opened_by(rows.withColumn("_o", opens), F.col("_o")))


def nearest_parents(rows: DataFrame, levels: int = 6) -> DataFrame:
    """Add ``parents``: position of the nearest heading above, per level below that of the row; deeper headings end at a higher one."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for i in range(levels):
        out = out.withColumn(f"_p{i}", F.last(F.when(F.col("level") == i, F.col("pos")), ignorenulls=True).over(w))
    own = F.coalesce(F.col("level"), F.lit(levels))
    kept = []
    for i in range(levels):
        higher = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_p{k}"), F.lit(-1)) for k in range(i)]) if i > 1 else (F.coalesce(F.col("_p0"), F.lit(-1)) if i == 1 else F.lit(-1))
        kept.append(F.when((own > i) & (F.col(f"_p{i}") > higher), F.col(f"_p{i}")))
    return out.withColumn("parents", F.filter(F.array(*kept), lambda x: x.isNotNull())).drop(*[f"_p{i}" for i in range(levels)])


def heading_tree(rows: DataFrame, levels: int = 6) -> DataFrame:
    """(doc_id, head, title, body): each heading with all lines down to the next of its level or a higher one.

    A line belongs to its nearest headings above, one per level at most, so lines meet as many headings as there are levels.
    Headings without a line below them are left out.
    """
    below = nearest_parents(rows, levels).select("doc_id", "pos", "text", F.explode("parents").alias("head"))
    heads = rows.where("level is not null").select("doc_id", F.col("pos").alias("head"), F.col("text").alias("title"))
    return below.join(heads, ["doc_id", "head"]).groupBy("doc_id", "head", "title").agg(_in_order(F.col("text"), F.col("pos")).alias("body"))


def question_paths(rows: DataFrame) -> DataFrame:
    """(doc_id, question, answer) of Markdown: the heading path is the question, the text below it the answer; code fences hide headings."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("text").startswith("```").cast("int")).over(w) % 2 == 1
    depth = F.when(~fence & F.col("text").rlike(MARKDOWN_HEADING), F.length(F.regexp_extract("text", MARKDOWN_HEADING, 1)))
    out = rows.withColumn("depth", depth)
    for i in range(1, 7):
        title = F.last(F.when(F.col("depth") == i, F.struct("pos", F.regexp_replace("text", MARKDOWN_HEADING, "").alias("t"))), ignorenulls=True).over(w)
        out = out.withColumn(f"_t{i}", title)
    path, last = [], F.lit(-1)
    for i in range(1, 7):
        ok = F.col(f"_t{i}.pos") > last
        path.append(F.when(ok, F.col(f"_t{i}.t")))
        last = F.when(ok, F.col(f"_t{i}.pos")).otherwise(last)
    out = out.withColumn("question", F.array_join(F.filter(F.array(*path), lambda x: x.isNotNull()), "\n"))
    out = opened_by(out, F.col("depth").isNotNull()).where("depth is null")
    return out.groupBy("doc_id", "group").agg(F.first("question").alias("question"), _in_order(F.col("text"), F.col("pos")).alias("answer")).where("trim(answer) <> '' and question <> ''")


def merge_fold(sections: list[str], budget: int, overlap: float = 0.0, delimiters: str = "\n。；！？", split_large: bool = True, count=lambda t: len(t.split())) -> list[str]:
    """Append sections to the chunk until it exceeds the budget less the overlap; a new chunk may begin with the
    end of the one before. Sections at or above the budget are cut at the delimiters, which are dropped."""
    pattern = delimiter_pattern(delimiters)
    chunks, sizes = [""], [0]

    def add(text: str) -> None:
        n = count(text)
        if chunks[-1] == "" or sizes[-1] <= budget * (1 - overlap):
            chunks[-1] = chunks[-1] + ("\n" if chunks[-1] else "") + text
            sizes[-1] += n
            return
        if overlap > 0:
            tail = chunks[-1][int(len(chunks[-1]) * (1 - overlap)) :]
            text = tail + text
            n = count(text)
        chunks.append(text)
        sizes.append(n)

    for s in sections:
        if not s.strip():
            continue
        if split_large and pattern and count(s) >= budget:
            for part in re.split(pattern, s):
                if part.strip():
                    add(part)
        else:
            add(s)
    return [x for x in chunks if x.strip()]


def folded(df: DataFrame, fold, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, text): a fold over the lines of each document, one document at a time in Arrow batches."""

    def run(batches):
        for b in batches:
            ids, nos, texts = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, c in enumerate(fold((t or "").split("\n"))):
                    ids.append(d)
                    nos.append(k)
                    texts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_no", "text"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, chunk_no int, text string")


def naive_merge(df: DataFrame, budget: int = 128, overlap: float = 0.0, delimiters: str = "\n。；！？", **names) -> DataFrame:
    return folded(df, lambda s: merge_fold(s, budget, overlap, delimiters), **names)


def text_merge(df: DataFrame, budget: int = 128, **names) -> DataFrame:
    """Plain text: append pieces until the budget is exceeded, no overlap and no cutting."""
    return folded(df, lambda s: merge_fold(s, budget, 0.0, "", split_large=False), **names)


def markdown_fold(text_lines: list[str], least: int, most: int, count=lambda t: len(t.split())) -> list[str]:
    """Structured Markdown: break before headings, rules and big tables once ``least`` is reached, and at ``most``; tables stay whole."""
    blocks: list[tuple[str, str]] = []
    fence, table = False, []
    for line in text_lines:
        if line.startswith("```"):
            fence = not fence
        is_row = not fence and line.lstrip().startswith("|")
        if is_row:
            table.append(line)
            continue
        if table:
            blocks.append(("table", "\n".join(table)))
            table = []
        kind = "text" if fence else "heading" if re.match(MARKDOWN_HEADING, line) else "rule" if re.match(r"^(-{3,}|\*{3,})\s*$", line) else "text"
        blocks.append((kind, line))
    if table:
        blocks.append(("table", "\n".join(table)))
    out, at, size = [], [], 0
    for kind, t in blocks:
        n = count(t)
        breaks = size >= least and (kind in ("heading", "rule") or kind == "table" and n > most / 2)
        if at and (breaks or size + n > most):
            out.append("\n".join(at))
            at, size = [], 0
        if kind != "rule":
            at.append(t)
            size += n
    if at:
        out.append("\n".join(at))
    return [x for x in out if x.strip()]


def markdown_smart(df: DataFrame, least: int = 20, most: int = 256, **names) -> DataFrame:
    return folded(df, lambda s: markdown_fold(s, least, most), **names)


def heading_sections(text_lines: list[str], depth: int = 3) -> list[str]:
    """Sections at headings down to ``depth``, code fences ignored."""
    out: list[list[str]] = [[]]
    fence = False
    for line in text_lines:
        if line.startswith("```"):
            fence = not fence
        m = re.match(MARKDOWN_HEADING, line)
        if m and not fence and len(m.group(1)) <= depth:
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out if "\n".join(x).strip()]


def size_controlled(sections: list[str], target: int, count=lambda t: len(t.split())) -> list[str]:
    """Cut sections above 1.2 targets by lines, merge small ones with the next while within 1.2 targets; tables and code stay whole."""
    cut: list[str] = []
    for s in sections:
        special = "```" in s or "\n|" in s
        cut += [s] if special or count(s) <= 1.2 * target else merge_fold(s.split("\n"), target)
    out: list[str] = []
    for s in cut:
        if out and count(out[-1]) < 0.5 * target and count(out[-1]) + count(s) <= 1.2 * target:
            out[-1] += "\n" + s
        else:
            out.append(s)
    return out


def markdown_advanced(df: DataFrame, target: int = 128, **names) -> DataFrame:
    return folded(df, lambda s: size_controlled(heading_sections(s), target), **names)


STRATEGIES = {"basic": naive_merge, "smart": markdown_smart, "advanced": markdown_advanced}


def chunk(df: DataFrame, strategy: str, **options) -> DataFrame:
    """Dispatch by strategy name; unknown ones fall back to 'smart'. 'strict_regex' needs ``pattern``."""
    if strategy == "strict_regex":
        out = strict_regex(df, options.pop("pattern"), **options)
        return out.select("doc_id", F.col("group").cast("int").alias("chunk_no"), "text")
    return STRATEGIES.get(strategy, markdown_smart)(df, **options)


def by_page(rows: DataFrame) -> DataFrame:
    """One chunk per page (presentations)."""
    return rows.groupBy("doc_id", "page").agg(_in_order(F.col("text"), F.col("pos")).alias("text"))


def page_tasks(docs: DataFrame, pages: str, size: int) -> DataFrame:
    """(doc_id, from_page, to_page): ranges of ``size`` pages; documents without pages have none."""
    return docs.where(F.col(pages) > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col(pages) - 1, F.lit(size))).alias("from_page"), F.col(pages).alias("_n")).select("doc_id", "from_page", F.least(F.col("from_page") + size, "_n").alias("to_page"))


def task_digest(config: Column, doc_id: Column, from_page: Column, to_page: Column) -> Column:
    return F.md5(F.concat_ws("|", config, doc_id.cast("string"), from_page.cast("string"), to_page.cast("string")))


def reusable(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks with the finished one of equal digest: its chunks are reused; null where there is none."""
    return tasks.join(done.select("digest", F.col("chunk_ids").alias("reused")), "digest", "left")


def without_contents(rows: DataFrame, look: int = 128) -> DataFrame:
    """Drop a table of contents: from its heading to where its first entry recurs, at most ``look`` lines on."""
    head = rows.where(F.lower(F.regexp_replace("text", r"[\s　]", "")).isin("contents", "tableofcontents", "目录", "目次")).groupBy("doc_id").agg(F.min("pos").alias("_from"))
    first = rows.join(head, "doc_id").where((F.col("pos") > F.col("_from")) & (F.trim("text") != "")).groupBy("doc_id", "_from").agg(F.min_by(F.substring(F.trim("text"), 1, 8), "pos").alias("_prefix"), F.min("pos").alias("_first"))
    again = rows.join(first, "doc_id").where((F.col("pos") > F.col("_first")) & (F.col("pos") <= F.col("_first") + look) & F.trim("text").startswith(F.col("_prefix"))).groupBy("doc_id", "_from").agg(F.min("pos").alias("_to"))
    gone = rows.join(again, "doc_id").where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))).select("doc_id", "pos")
    return rows.join(gone, ["doc_id", "pos"], "left_anti")
