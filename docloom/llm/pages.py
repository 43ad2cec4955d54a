"""Repair of scanned documents as a job: running lines, the model, faults per block, and paragraphs."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scanned as sc
from docloom.runtime import materialize, small

PAGES = 3
#: What a line that holds only a page number looks like.
PAGE_NUMBER = r"(?i)^\s*(?:[-–—·\[(]?\s*(?:p\.|pp\.|pág\.|page|página|s\.|seite|第)?\s*[\dlIoO]{1,4}\s*(?:页)?(?:\s*(?:of|/|de|von|sur)\s*[\dlIoO]{1,4})?\s*[-–—·\])]?|[ivxl]{1,7})\s*$"
WRAPPED = r"[\p{L}&&[^一-鿿]][-\xad¬‐‑][ \t]*\n[ \t]*[\p{L}&&[^一-鿿]]"
_HAN_RUNS = re.compile("[一-鿿]+")
#: Longest line that can be a running header or footer.
LINE = 120
#: Least relative frequency of what the model keeps: bounds each of its tables to the inverse, whatever the corpus.
RARE = 5e-7


def lines_of(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, page_idx, leveled, line_no, line, key, numbered) of the short lines of all but tables.

    ``key`` has the letters of a line only, so page numbers do not tell running lines apart; it is null for lines
    that end a sentence.
    """
    rows = blocks.where("text is not null and coalesce(block_type, '') <> 'table' and document_id is not null").select("document_id", "block_id", "page_idx", F.col("text_level").isNotNull().alias("leveled"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.where((F.length("line") <= LINE) & (F.trim("line") != ""))
    letters = F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "")
    return rows.withColumn("numbered", F.col("line").rlike(PAGE_NUMBER)).withColumn("key", F.when(~F.col("line").rlike(r"[.。;；!?！？:]\s*$") & (F.length(letters) >= 2), letters))


def running_keys(lines: DataFrame, pages: int = PAGES) -> DataFrame:
    """(document_id, key): lines that recur on at least ``pages`` pages of a document, with their misread forms.

    A misread form is near (edit distance) to a key seen on two or more pages and shares its first or last four
    letters. Keys that only ever are headings (with a text level) do not count.
    """
    seen = lines.where("key is not null").groupBy("document_id", "key", "page_idx").agg(F.min("leveled").alias("leveled"))
    keys = materialize(seen.groupBy("document_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("leveled").cast("int")).alias("n_leveled")))
    ends = lambda k: F.array(F.concat(F.lit("<"), F.substring(k, 1, 4)), F.concat(F.lit(">"), F.substring(k, -4, 4)))
    centre = keys.where("n >= 2").select("document_id", F.col("key").alias("centre"), F.col("n").alias("_n"), F.col("n_leveled").alias("_lv"), F.explode(ends("key")).alias("_end"))
    others = keys.where("n < 3 and length(key) >= 5").select("document_id", "key", "n", "n_leveled", F.explode(ends("key")).alias("_end"))
    near = (
        others.join(centre, ["document_id", "_end"])
        .where((F.col("key") != F.col("centre")) & (F.abs(F.length("key") - F.length("centre")) <= 3) & (F.levenshtein("key", "centre") <= F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.length("centre") / 5)))))
        .select("document_id", "centre", "key", "n", "n_leveled")
        .distinct()
    )
    sums = near.groupBy("document_id", "centre").agg(F.sum("n").alias("_more"), F.sum("n_leveled").alias("_mlv"))
    ok = (
        keys.where("n >= 2").select("document_id", F.col("key").alias("centre"), "n", "n_leveled").join(sums, ["document_id", "centre"], "left")
        .where((F.col("n") + F.coalesce("_more", F.lit(0)) >= pages) & ((F.col("n_leveled") + F.coalesce("_mlv", F.lit(0))) <= 0.6 * (F.col("n") + F.coalesce("_more", F.lit(0)))))
        .select("document_id", "centre")
    )
    return ok.select("document_id", F.col("centre").alias("key")).unionByName(near.join(ok, ["document_id", "centre"], "left_semi").select("document_id", "key")).distinct()


def furniture(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, furniture): numbers of the lines that are running lines or page numbers."""
    lines = lines_of(blocks)
    keys = materialize(running_keys(lines))
    hit = lines.where("key is not null and not numbered").join(small(keys.withColumn("_run", F.lit(True))), ["document_id", "key"], "left_semi").select("document_id", "block_id", "line_no")
    return hit.unionByName(lines.where("numbered").select("document_id", "block_id", "line_no")).groupBy("document_id", "block_id").agg(F.array_sort(F.collect_set("line_no")).alias("furniture"))


def noisy_documents(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id): documents with running lines or page numbers, or with words broken at line ends."""
    wrapped = blocks.where(F.col("text").rlike(WRAPPED) | F.exists(F.coalesce("image_caption", F.array().cast("array<string>")), lambda c: F.coalesce(c.rlike(WRAPPED), F.lit(False))))
    return found.select("document_id").unionByName(wrapped.select("document_id")).where("document_id is not null").distinct()


def learn(clean: DataFrame, noisy: DataFrame):
    """Broadcast model of the clean texts (column ``text``), and of the words that only the noisy ones have. Counted in
    the cluster over all of them.

    Each table keeps what reaches RARE of its total and occurs twice, hence at most 1/RARE entries.
    """

    def count_words(batches):
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(sc.WORD.findall(t.lower()))
            if len(words) > 400_000:
                yield _rows(n=words)
                words = Counter()
        yield _rows(n=words)

    def count(batches):
        got = {k: Counter() for k in "wpcmhg"}
        for b in batches:
            for t in b.column(0).to_pylist():
                low = t.lower().replace("\n", " ")
                words = sc.WORD.findall(low)
                got["w"].update(words)
                got["p"].update(zip(words, words[1:]))
                if "-" in low:
                    got["c"].update(sc.COMPOUND.findall(low))
                got["m"].update(sc.marks(t.replace("\n", " ")))
                for run in _HAN_RUNS.findall(t):
                    got["h"].update(run)
                    got["g"].update(zip(run, run[1:]))
            if sum(map(len, got.values())) > 400_000:
                yield _rows(**got)
                got = {k: Counter() for k in "wpcmhg"}
        yield _rows(**got)

    def _rows(**got: Counter):
        """Counts by kind; numbers are no words, and pairs of words stand with a blank between."""
        joint = {"p": " ", "g": ""}
        rows = []
        for k, counts in got.items():
            if k in joint:
                rows += [(k, joint[k].join(x), n) for x, n in counts.items() if k == "g" or not (x[0].isdigit() or x[1].isdigit())]
            else:
                rows += [(k, x, n) for x, n in counts.items() if k not in "wn" or not x.isdigit()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "item", "n"])

    kinds = "kind string, item string, n bigint"
    seen = clean.where("text is not null").select("text").mapInArrow(count, kinds).unionByName(noisy.where("text is not null").select("text").mapInArrow(count_words, kinds))
    counts = materialize(seen.groupBy("kind", "item").agg(F.sum("n").alias("n")))
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    floor = {k: max(2.0, RARE * n) for k, n in totals.items()}
    floor["m"] = max(2.0, 1e-5 * totals.get("m", 0))
    keep = F.lit(False)
    for k, n in floor.items():
        keep = keep | ((F.col("kind") == k) & (F.col("n") >= n))
    kept = counts.where(keep)
    # of the pairs only those count that could be one word
    words = kept.where("kind = 'w'").select(F.col("item").alias("_w"))
    pairs = kept.where("kind = 'p'").join(words, F.regexp_replace("item", " ", "") == F.col("_w"), "left_semi")
    odd = kept.where("kind = 'n' and n >= 3").join(words, F.col("item") == F.col("_w"), "left_anti")
    rows = kept.where("kind not in ('p', 'n')").unionByName(pairs).unionByName(odd).toPandas()
    of = lambda k: rows[rows.kind == k]
    han, grams = of("h"), of("g")
    model = sc.Model(dict(zip(of("w").item, of("w").n.astype(int))), set(of("p").item), set(of("c").item), set(of("m").item), dict(zip(han.item, han.n.astype(int))), dict(zip(grams.item, grams.n.astype(int))), dict(zip(of("n").item, of("n").n.astype(int))))
    return clean.sparkSession.sparkContext.broadcast(model)


def repaired(rows: DataFrame, model) -> DataFrame:
    """rows (block_id, document_id, text, image_caption, furniture) of noisy documents -> (block_id, kinds, repaired).

    kinds as TESTDATA.md names them; ``repaired`` is the text without running lines, words joined and read.
    """
    types = [pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        m = model.value
        for b in batches:
            out: list[list] = [[], [], []]
            for bid, text, captions, lines_out in zip(*[b.column(i).to_pylist() for i in range(4)]):
                kinds, text_ = judge(text, captions, set(lines_out or ()), m)
                out[0].append(bid)
                out[1].append(kinds)
                out[2].append(text_)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["block_id", "kinds", "repaired"])

    return rows.select("block_id", "text", "image_caption", "furniture").mapInArrow(run, "block_id string, kinds array<string>, repaired string")


def judge(text: str | None, captions: list | None, furniture: set[int], model: sc.Model) -> tuple[list[str], str | None]:
    """(kinds, repaired text) of one block; null and blank texts have no fault and repair to null."""
    kinds: list[str] = []
    lines = (text or "").split("\n")
    body = [x for i, x in enumerate(lines) if i not in furniture and x.strip()]
    fixed = None
    if furniture:
        kinds.append("furniture")
    if body:
        if sc.broken_words(body, model):
            kinds.append("hyphen")
        whole, fragment = sc.delined(body, model)
        bad, fixed = sc.misread(whole, model)
        if fragment:
            fixed = (fixed + " " + fragment + BROKEN_OFF).lstrip()
        if bad:
            kinds.append("ocr")
    for c in captions or ():
        part = [x for x in (c or "").split("\n") if x.strip()]
        if part and (sc.broken_words(part, model) or sc.misread(sc.delined(part, model)[0], model)[0]):
            kinds.append("caption")
            break
    return kinds, fixed


#: Stands at the end of a repaired block whose last word goes on in the next one.
BROKEN_OFF = "\xad"
#: Block numbers of a document that one task decides on, and how many to both sides it looks at.
SPAN, HALO = 512, 128


def paragraph_cost(left: str, right: str, right_level: bool, same_page: bool) -> tuple[float, float]:
    """(cost of joining, cost of breaking) between neighbouring blocks."""
    ended = bool(re.search(r"[.!?。！？:：][\"'»”’)\]]*$", left))
    starts_low = bool(right[:1].islower() or right[:1].isdigit() and not ended)
    join = 0.5 + (3.0 if ended else 0.0) + (0.0 if starts_low else 1.0) + (1.0 if same_page else 0.0) + (6.0 if right_level else 0.0)
    cut = 1.0 + (0.0 if ended else 3.0) + (2.0 if starts_low else 0.0)
    return join, cut


def boundaries(texts: list[str], levels: list[bool], pages: list[int], aim: int = 900) -> list[int]:
    """First block of each paragraph, by dynamic programming over all ways to put neighbours together.

    A paragraph costs what its inner joins and its opening break cost, and what it is longer than ``aim`` characters, over ``aim``. Up to ``aim``
    all beginnings of the paragraph are looked at; beyond, a block adds the same whatever the beginning, so the best one is carried on.
    """
    n = len(texts)
    pairs = [(0.0, 0.0)] + [paragraph_cost(texts[i - 1], texts[i], levels[i] or levels[i - 1], pages[i] == pages[i - 1]) for i in range(1, n)]
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    long_: tuple[float, int] = (float("inf"), 0)  # cheapest paragraph of at least ``aim`` characters that ends here, and its beginning
    for j in range(1, n + 1):
        long_ = (long_[0] + pairs[j - 1][0] + len(texts[j - 1]) / aim, long_[1])
        inner, length = 0.0, 0
        for i in range(j - 1, -1, -1):
            length += len(texts[i])
            if length - len(texts[j - 1]) >= aim:
                break  # was as long before this block
            cost = best[i] + (pairs[i][1] if i else 0.0) + inner + max(0.0, length - aim) / aim
            if length >= aim:
                long_ = min(long_, (cost, i))
            elif cost < best[j]:
                best[j], back[j] = cost, i
            inner += pairs[i][0]
        if long_[0] < best[j]:
            best[j], back[j] = long_
    out, j = [], n
    while j:
        out.append(back[j])
        j = back[j]
    return out[::-1]


def joined(texts: list[str]) -> str:
    """Repaired blocks of one paragraph as running text: a word that was broken off goes on without a blank, as ideographs do."""
    out = ""
    for t in texts:
        if out.endswith(BROKEN_OFF):
            out = out[:-1] + t
        elif out and not ("一" <= out[-1] <= "鿿" and "一" <= t[:1] <= "鿿"):
            out += " " + t
        else:
            out += t
    return out.rstrip(BROKEN_OFF)


def paragraphs(rows: DataFrame) -> DataFrame:
    """rows (document_id, block_no, block_id, page_idx, leveled, repaired) -> (document_id, paragraph_no, page_from, page_to, block_ids, text).

    Blocks without repaired text take no part. Documents are worked on in spans of SPAN block numbers, each seen with HALO numbers to both sides, so that none is
    gathered as a whole and a span's edge is decided like any other place; where paragraphs begin is then counted through the document.
    """
    some = rows.where("repaired is not null and repaired <> ''").withColumn("block_no", F.coalesce("block_no", F.lit(0)))
    near = F.array_distinct(F.array(F.floor((F.col("block_no") - HALO) / SPAN), F.floor(F.col("block_no") / SPAN), F.floor((F.col("block_no") + HALO) / SPAN)))
    seen = some.withColumn("span", F.explode(near)).withColumn("own", F.floor(F.col("block_no") / SPAN) == F.col("span"))
    grouped = seen.groupBy("document_id", "span").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "page_idx", "leveled", "own", "repaired"))).alias("blocks"))

    def run(batches):
        names = ["document_id", "span", "place", "opens", "block_id", "page_idx", "repaired"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            out = []
            for r in b.to_pylist():
                bl = r["blocks"]
                if not any(x["own"] for x in bl):
                    continue
                pages = [x["page_idx"] if x["page_idx"] is not None else 0 for x in bl]
                starts = set(boundaries([x["repaired"] for x in bl], [bool(x["leveled"]) for x in bl], pages))
                out += [(r["document_id"], r["span"], i, int(i in starts), x["block_id"], pages[i], x["repaired"]) for i, x in enumerate(bl) if x["own"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    decided = materialize(grouped.mapInArrow(run, "document_id string, span bigint, place int, opens int, block_id string, page_idx int, repaired string"))
    per = decided.groupBy("document_id", "span").agg(F.sum("opens").alias("_o"))
    ahead = per.select("document_id", "span", (F.sum("_o").over(Window.partitionBy("document_id").orderBy("span")) - F.col("_o")).alias("_before"))
    inside = Window.partitionBy("document_id", "span").orderBy("place")
    numbered = decided.withColumn("_in", F.sum("opens").over(inside)).join(ahead, ["document_id", "span"]).withColumn("paragraph_no", (F.greatest(F.col("_before") + F.col("_in"), F.lit(1)) - 1).cast("int"))
    put = numbered.groupBy("document_id", "paragraph_no").agg(F.min("page_idx").alias("page_from"), F.max("page_idx").alias("page_to"), F.array_sort(F.collect_list(F.struct("span", "place", "block_id", "repaired"))).alias("_b"))

    def write(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([joined(t) for t in b.column(5).to_pylist()], pa.string())], names=["document_id", "paragraph_no", "page_from", "page_to", "block_ids", "text"])

    texts = put.select("document_id", "paragraph_no", "page_from", "page_to", F.transform("_b", lambda x: x["block_id"]).alias("block_ids"), F.transform("_b", lambda x: x["repaired"]).alias("_t"))
    return texts.mapInArrow(write, "document_id string, paragraph_no int, page_from int, page_to int, block_ids array<string>, text string")
