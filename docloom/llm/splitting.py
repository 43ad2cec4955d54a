"""Splitting oversized items at natural boundaries, by ranges.

An item is read as ranges of ``RANGE`` characters (bytes for files) with halos, so a giant item is
spread over many tasks. Workers count token starts and detect boundaries in their range; the small
boundary tables are stitched, token counts and lengths are prefix-summed over ranges, the cuts are chosen on token
numbers, and pieces are emitted by offset from the ranges they overlap. No task ever holds a whole giant file.

Where a piece ends depends on where it begins only, so the cuts of a block of tokens are a map from the place at which it
is entered to the place at which it is left. Blocks are mapped at once, maps are composed in tiers, and each block then cuts from its
own entry: the pieces are those of one pass from the beginning, however the text is dealt.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import HAN, SPACE
from docloom.runtime import materialize, release

RANGE = 1 << 16
HALO = 256
#: Tokens whose cuts are chosen by one task, at least; sixteen limits where that is more.
BLOCK = 1 << 16
#: Maps of blocks that one task composes.
FAN = 256
#: A gap of white space longer than this is the end of a paragraph, whatever stands before it.
GAP = 1 << 16

#: A token that starts at this character: an ideograph, or another non-space character after a space or ideograph.
START = rf"[{HAN}]|(?<![^{SPACE}{HAN}])[^{SPACE}{HAN}]"
PY_START = re.compile(r"[一-鿿]|(?<![^\s一-鿿])[^\s一-鿿]")
#: Boundary kinds, strongest last.
SENTENCE, ITEM, PARAGRAPH, HEADING = 1, 2, 3, 4
BOUNDARY = re.compile(
    r"(?P<h>(?:\n[ \t]*)+(?=#{1,6} ))|(?P<i>(?:\n[ \t]*)+(?=(?:[-*•]|\(?\d{1,4}[.)]|\(?[a-z][.)])(?: |(?<=\)))))|(?P<p>\n[ \t]*\n\s*)"
    r"|(?P<s>[.!?…]+[\"'»”’)\]]*(?:[ \t]+|(?=\n))|[。！？；]+[”’」』）]*[ \t]*|\n)"
)
KINDS = {"h": HEADING, "p": PARAGRAPH, "i": ITEM, "s": SENTENCE}


_RANGED = "item string, limit int, overlap double, range_no bigint, lead int, slice string, own int"


def ranges(items: DataFrame, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """items (item, limit, overlap, text) -> (item, limit, overlap, range_no, lead, slice, own): one row per range of each text.

    ``slice`` starts ``lead`` characters before the range and ends up to ``halo`` after it; ``own`` is the range's
    length. The lead reaches over white space before the range, and ``halo`` further. Null and empty texts have no range.
    """
    rows = items.where("text is not null and text <> ''").select(F.col("item").cast("string").alias("item"), F.col("limit").cast("int").alias("limit"), F.col("overlap").cast("double").alias("overlap"), "text")
    short = rows.where(F.length("text") <= range_chars).select("item", "limit", "overlap", F.lit(0).cast("bigint").alias("range_no"), F.lit(0).alias("lead"), F.col("text").alias("slice"), F.length("text").alias("own"))

    def cut(batches):
        for b in batches:
            for item, limit, overlap, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                for first in range(0, -(-len(text) // range_chars), 64):
                    out = []
                    for k in range(first, min(first + 64, -(-len(text) // range_chars))):
                        begin = k * range_chars
                        lead = _lead(text[max(0, begin - GAP - halo) : begin], halo)
                        out.append((item, limit, overlap, k, lead, text[begin - lead : begin + range_chars + halo], min(range_chars, len(text) - begin)))
                    yield _batch(out)

    return short.unionByName(rows.where(F.length("text") > range_chars).mapInArrow(cut, _RANGED))


def _lead(before: str, halo: int) -> int:
    """Characters to show before a range: white space, and ``halo`` more."""
    return min(len(before), len(before) - len(before.rstrip()) + halo)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    names = ["item", "limit", "overlap", "range_no", "lead", "slice", "own"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def starts_in(lead: Column, text: Column, own: Column) -> Column:
    """Token starts in a range: those of lead and range less those of the lead."""
    whole = F.regexp_count(F.substring(text, F.lit(1), lead + own), F.lit(START))
    return (whole - F.when(lead > 0, F.regexp_count(F.substring(text, F.lit(1), lead), F.lit(START))).otherwise(F.lit(0))).cast("bigint")


def counted(ranged: DataFrame) -> DataFrame:
    return ranged.withColumn("n_starts", starts_in(F.col("lead"), F.col("slice"), F.col("own")))


def stitched(counts: DataFrame) -> DataFrame:
    """(item, n_tokens): tokens of whole items from the counts of their ranges."""
    return counts.groupBy("item").agg(F.sum("n_starts").alias("n_tokens"))


def may_exceed(text: Column, limit: Column) -> Column:
    """False where a text has no more tokens than ``limit`` by its size alone: an ideograph takes three bytes, and any
    other token a character and one between it and the next, so there is at most one token to two bytes."""
    return (F.octet_length(text) + 1) / 2 > limit


def oversized(items: DataFrame) -> DataFrame:
    """(item, limit, n_tokens) of the items (item, limit, overlap, text) with more tokens than their limit."""
    counts = counted(ranges(items.where(may_exceed(F.col("text"), F.col("limit")))))
    return counts.groupBy("item", "limit").agg(F.sum("n_starts").alias("n_tokens")).where(F.col("n_tokens") > F.col("limit"))


def detect(text: str, lead: int, own: int) -> tuple[list[int], list[int], list[int]]:
    """Offsets (in the range) of token starts; numbers (among them) of those that begin after a boundary, and its kind.

    A boundary sits at the first token start after its mark and is owned by the range that holds that start,
    so a mark that straddles two ranges is found once.
    """
    starts = [m.start() - lead for m in PY_START.finditer(text) if lead <= m.start() < lead + own]
    number = {o: i for i, o in enumerate(starts)}
    at: dict[int, int] = {}
    for m in BOUNDARY.finditer(text):
        n = PY_START.search(text, m.end())
        if n and n.start() - lead in number:
            i = number[n.start() - lead]
            at[i] = max(at.get(i, 0), KINDS[m.lastgroup])
    if starts and lead + starts[0] - len(text[: lead + starts[0]].rstrip()) > GAP:
        at[0] = max(at.get(0, 0), PARAGRAPH)
    marks = sorted(at)
    return starts, marks, [at[i] for i in marks]


def boundary_tables(ranged: DataFrame) -> DataFrame:
    """(item, limit, overlap, range_no, own, starts, marks, kinds) per range, Arrow batch by batch."""
    schema = "item string, limit int, overlap double, range_no bigint, own int, starts array<int>, marks array<int>, kinds array<int>"
    types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["item", "limit", "overlap", "range_no", "own", "starts", "marks", "kinds"]

    def run(batches):
        for b in batches:
            rows = [(r["item"], r["limit"], r["overlap"], r["range_no"], r["own"], *detect(r["slice"], r["lead"], r["own"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return ranged.select("item", "limit", "overlap", "range_no", "lead", "slice", "own").mapInArrow(run, schema)


def prefixed(tables: DataFrame, tier: int = 4096) -> DataFrame:
    """Add what stands before each range, and the totals of its item: first, base, n_tokens, n_chars. Sums run over groups of ``tier`` ranges
    first, then inside each."""
    sizes = tables.select("item", "range_no", F.size("starts").cast("bigint").alias("_n"), F.col("own").cast("bigint").alias("_o"), F.floor(F.col("range_no") / tier).alias("_t"))
    upper = sizes.groupBy("item", "_t").agg(F.sum("_n").alias("_sn"), F.sum("_o").alias("_so"))
    w, every = Window.partitionBy("item").orderBy("_t"), Window.partitionBy("item")
    upper = upper.select("item", "_t", (F.sum("_sn").over(w) - F.col("_sn")).alias("_bn"), (F.sum("_so").over(w) - F.col("_so")).alias("_bo"), F.sum("_sn").over(every).alias("n_tokens"), F.sum("_so").over(every).alias("n_chars"))
    inside = Window.partitionBy("item", "_t").orderBy("range_no")
    placed = sizes.withColumn("first", F.sum("_n").over(inside) - F.col("_n")).withColumn("base", F.sum("_o").over(inside) - F.col("_o")).join(upper, ["item", "_t"])
    places = placed.select("item", "range_no", (F.col("first") + F.col("_bn")).alias("first"), (F.col("base") + F.col("_bo")).alias("base"), "n_tokens", "n_chars")
    return tables.join(places, ["item", "range_no"])


def next_cut(at: int, end: int, limit: int, back: int, marks: list[int], kinds: list[int]) -> tuple[int, int]:
    """(first token, end) of the piece whose new text begins at token ``at``: the piece repeats up to ``back`` tokens before it.

    It ends at the strongest boundary of its last half, the latest of equals; else at the latest boundary; else at the limit.
    ``marks`` are the rising token numbers of boundaries, at least of those up to ``at + limit``.
    """
    repeat = min(back, at)
    stop = min(end, at + limit - repeat)
    if stop < end:
        best, where, half = 0, stop, (stop - at) / 2
        i = bisect_right(marks, stop) - 1
        while i >= 0 and marks[i] > at and not (best and marks[i] - at < half):
            if kinds[i] > best:
                best, where = kinds[i], marks[i]
            i -= 1
        stop = where
    return at - repeat, stop


def _exits(entries: int, begin: int, until: int, end: int, limit: int, back: int, marks: list[int], kinds: list[int]) -> list[int]:
    """For each of the first ``entries`` tokens from ``begin`` on: how far behind ``until`` the cuts from there leave the block."""
    known: dict[int, int] = {}
    out = []
    for e in range(begin, begin + entries):
        path, at = [], e
        while at < until and at not in known:
            path.append(at)
            at = next_cut(at, end, limit, back, marks, kinds)[1]
        left = at - until if at >= until else known[at]
        for p in path:
            known[p] = left
        out.append(left)
    return out


def _entries(maps: DataFrame, fan: int) -> DataFrame:
    """maps (item, k, exits) of the blocks 0..n-2 of each item -> (item, k, entry) of the blocks 1..n-1.

    Maps are composed ``fan`` at a time, tier by tier, until one group is left; then each group is entered and walked.
    """
    groups = materialize(maps.groupBy("item", F.floor(F.col("k") / fan).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "exits"))).alias("maps")))
    most = groups.agg(F.max("g")).first()[0]
    entered = groups.select("item", F.lit(0).cast("bigint").alias("g"), F.lit(0).alias("entry")).where("false")
    if most:

        def compose(batches):
            for b in batches:
                rows = []
                for item, g, parts in zip(*[b.column(i).to_pylist() for i in range(3)]):
                    at = list(range(len(parts[0]["exits"])))
                    for p in parts:
                        at = [p["exits"][x] for x in at]
                    rows.append((item, g, at))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["item", "k", "exits"])

        entered = _entries(groups.where(F.size("maps") == fan).select("item", "g", "maps").mapInArrow(compose, "item string, k bigint, exits array<int>"), fan).withColumnRenamed("k", "g")

    def walk(batches):
        for b in batches:
            rows = []
            for item, parts, at in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for p in parts:
                    at = p["exits"][at]
                    rows.append((item, p["k"] + 1, at))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["item", "k", "entry"])

    return groups.join(entered, ["item", "g"], "left").select("item", "maps", F.coalesce("entry", F.lit(0)).alias("entry")).mapInArrow(walk, "item string, k bigint, entry int")


def cut_points(ranged: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(item, piece_no, start, new, end, n_tokens): offsets of the pieces of the items behind ``ranged``, in characters."""
    found = materialize(boundary_tables(ranged))  # several plans below read it: boundaries are looked for once
    tables = materialize(prefixed(found).where(F.size("starts") > 0))
    release(found)
    size = F.greatest(F.lit(block), F.col("limit") * 16).cast("bigint")
    last = F.floor((F.col("n_tokens") - 1) / size)
    low, high = F.floor(F.greatest(F.lit(0), F.col("first") - F.col("limit")) / size), F.floor((F.col("first") + F.size("starts") - 1 + F.col("limit")) / size)
    # a block sees a limit of tokens to both sides: those a piece repeats, and those it may reach
    touched = tables.withColumns({"_size": size, "_last": last}).withColumn("k", F.explode(F.sequence(low, F.least(high, F.col("_last")))))
    grouped = touched.groupBy("item", "k").agg(
        F.max("limit").alias("limit"), F.max("overlap").alias("overlap"), F.max("n_tokens").alias("n_tokens"), F.max("n_chars").alias("n_chars"), F.max("_size").alias("_size"), F.max("_last").alias("_last"),
        F.array_sort(F.collect_list(F.struct("first", "base", "starts", "marks", "kinds"))).alias("tables"),
    )
    several = not tables.where(F.col("n_tokens") > size).isEmpty()
    if several:
        grouped = materialize(grouped)

        def exits(batches):
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    marks, kinds = [t["first"] + m for t in r["tables"] for m in t["marks"]], [x for t in r["tables"] for x in t["kinds"]]
                    begin = r["k"] * r["_size"]
                    rows.append((r["item"], r["k"], _exits(r["limit"], begin, begin + r["_size"], r["n_tokens"], r["limit"], _back(r["overlap"], r["limit"]), marks, kinds)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["item", "k", "exits"])

        maps = materialize(grouped.where("k < _last").mapInArrow(exits, "item string, k bigint, exits array<int>"))
        grouped = grouped.join(_entries(maps, fan), ["item", "k"], "left")
    else:
        grouped = grouped.withColumn("entry", F.lit(0))
    schema = "item string, k bigint, j int, start bigint, new bigint, end bigint, n_tokens int"
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = ["item", "k", "j", "start", "new", "end", "n_tokens"]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                tables, end, limit, back = r["tables"], r["n_tokens"], r["limit"], _back(r["overlap"], r["limit"])
                marks, kinds = [t["first"] + m for t in tables for m in t["marks"]], [x for t in tables for x in t["kinds"]]
                firsts = [t["first"] for t in tables]

                def offset(t: int) -> int:
                    if t == 0 or t >= end:
                        return 0 if t == 0 else r["n_chars"]
                    at = tables[bisect_right(firsts, t) - 1]
                    return at["base"] + at["starts"][t - at["first"]]

                at = r["k"] * r["_size"] + (r["entry"] or 0)
                until, j = min(end, (r["k"] + 1) * r["_size"]), 0
                while at < until:
                    a, z = next_cut(at, end, limit, back, marks, kinds)
                    rows.append((r["item"], r["k"], j, offset(a), offset(at), offset(z), z - a))
                    at, j = z, j + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    chosen = grouped.select("item", "k", "entry", "limit", "overlap", "n_tokens", "n_chars", "_size", "tables").mapInArrow(run, schema)
    if not several:
        return chosen.select("item", F.col("j").alias("piece_no"), "start", "new", "end", "n_tokens")
    chosen = materialize(chosen)
    per = chosen.groupBy("item", "k").agg(F.count("*").alias("_c"))
    ahead = per.withColumn("_ahead", F.sum("_c").over(Window.partitionBy("item").orderBy("k")) - F.col("_c")).drop("_c")
    return chosen.join(ahead, ["item", "k"]).select("item", (F.col("_ahead") + F.col("j")).cast("int").alias("piece_no"), "start", "new", "end", "n_tokens")


def _back(overlap: float | None, limit: int) -> int:
    return max(0, min(int((overlap or 0.0) * limit), limit - 1))


def emitted(points: DataFrame, ranged: DataFrame) -> DataFrame:
    """Add the text of each piece, put together from the ranges it overlaps; white space at its end is trimmed."""
    own = ranged.select("item", "range_no", "lead", "slice", F.col("own").cast("bigint").alias("_own"))
    sums = own.select("item", "range_no", F.array_repeat(F.lit(0), 0).alias("starts"), F.col("_own").alias("own"))
    bases = prefixed(sums).select("item", "range_no", "base")
    placed = own.join(bases, ["item", "range_no"]).where("_own > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("base") / RANGE), F.floor((F.col("base") + F.col("_own") - 1) / RANGE))))
    touched = points.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / RANGE), F.floor((F.col("end") - 1) / RANGE))))
    low, high = F.greatest("start", "base"), F.least("end", F.col("base") + F.col("_own"))
    bits = touched.join(placed, ["item", "_b"]).where((low < high) & (F.floor(low / RANGE) == F.col("_b")))
    bits = bits.withColumn("_bit", F.substring("slice", (F.col("lead") + low - F.col("base") + 1).cast("int"), (high - low).cast("int")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "_bit"))), lambda x: x["_bit"]), "")
    return bits.groupBy("item", "piece_no", "start", "new", "end", "n_tokens").agg(text.alias("text")).withColumn("text", F.regexp_replace("text", rf"[{SPACE}]+$", ""))


def pieces(items: DataFrame, range_chars: int = RANGE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """items (item, text, limit, overlap) -> (item, piece_no, start, new, end, n_tokens, text) of oversized items.

    Offsets are characters; ``start`` < ``new`` where the piece repeats the end of the one before. A piece ends
    before the next token, white space at its end is kept in the offsets and trimmed in ``text``. Null and blank texts have no
    pieces; items are told apart by ``item``, so repeated ones must have been removed; other columns are ignored.
    """
    ranged = materialize(of_oversized(items, range_chars))
    return emitted(cut_points(ranged, block, fan), ranged)


def of_oversized(items: DataFrame, range_chars: int = RANGE) -> DataFrame:
    """The ranges of the oversized items only."""
    return ranges(items.join(oversized(items).select("item"), "item", "left_semi"), range_chars)


def pieces_of_files(spark: SparkSession, paths: list[str], limit: int, overlap: float = 0.0, range_bytes: int = RANGE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``pieces`` of UTF-8 files, each an item named by its path, that are only ever read range by range."""
    ranged = file_ranges(spark, paths, range_bytes).select("item", F.lit(limit).alias("limit"), F.lit(overlap).alias("overlap"), "range_no", "lead", "slice", "own")
    return emitted(cut_points(ranged, block, fan), ranged)


def file_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE, halo: int = HALO) -> DataFrame:
    """(item, range_no, lead, slice, own) of UTF-8 files, read by byte range through pyarrow's file systems.

    ``lead`` and ``own`` count characters here; a character belongs to the range in which its first byte lies.
    The lead reaches back over white space, as in :func:`ranges`.
    """
    from pyarrow import fs

    sizes = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        sizes.append((path, system.get_file_info(inner).size))
    files = spark.createDataFrame(sizes, "item string, size bigint").where("size > 0")
    total = sum(-(-n // range_bytes) for _, n in sizes)
    rows = files.select("item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / range_bytes) - 1)).alias("range_no"), "size").repartition(max(1, min(total, 100_000)), "item", "range_no")

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                system, inner = fs.FileSystem.from_uri(r["item"]) if "://" in r["item"] else (fs.LocalFileSystem(), r["item"])
                begin, reach = r["range_no"] * range_bytes, 2 * halo
                with system.open_input_file(inner) as f:
                    while True:
                        low, high = max(0, begin - reach), min(r["size"], begin + range_bytes + halo)
                        f.seek(low)
                        raw = f.read(high - low)
                        cut = lambda i: next((j for j in range(i, min(i + 4, len(raw))) if raw[j] & 0xC0 != 0x80), len(raw))  # noqa: E731,B023
                        a, m, z = cut(0) if low else 0, cut(begin - low), cut(min(begin + range_bytes, r["size"]) - low)
                        head = raw[a:m].decode("utf-8", "replace")
                        if not low or head.strip() or len(head) > GAP + halo:
                            break
                        reach *= 8  # nothing but white space so far
                lead = _lead(head, halo)
                own, tail = raw[m:z].decode("utf-8", "replace"), raw[z:].decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["item"]]), pa.array([r["range_no"]], pa.int64()), pa.array([lead], pa.int32()), pa.array([head[len(head) - lead :] + own + tail]), pa.array([len(own)], pa.int32())], names=["item", "range_no", "lead", "slice", "own"]
                )

    return rows.mapInArrow(read, "item string, range_no bigint, lead int, slice string, own int")
