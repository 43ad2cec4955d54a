"""Long exact spans shared between records, by suffix automata of reference shards.

A document cannot be streamed past the automaton of every other one: at any size that is quadratic. So
documents are first routed: every run of ``LEAST - WINDOW + 1`` window hashes has its smallest one chosen as
anchor, hence any two texts with a common span of ``LEAST`` characters share an anchor inside it. Regions
around equal anchors form a shard; its automaton holds the distinct regions as reference, and the same
regions are streamed for matching statistics. Spans of at least ``LEAST`` characters are kept.

Equal regions count as one in the automaton (groups of copies), and a shard of more than ``SHARD`` distinct
regions is split: each piece is a reference of its own past which all regions of the shard are streamed,
in slices of a bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.automaton import SuffixAutomaton
from docloom.llm.windows import codes, window_hashes, window_minima
from docloom.runtime import materialize, release, small

LEAST = 300
WINDOW = 200
SHARD = 400
def anchors(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(anchor, doc_id, at): the anchors of every text of ``least`` or more characters, and where each stands.

    ``docs``: doc_id, text. Null ids and texts take no part.
    """
    reach = least - window

    def run(batches):
        for b in batches:
            a, d, p = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(t) >= least:
                    h = window_hashes(codes(t), window)
                    at = window_minima(h, reach + 1)
                    a.append(h[at].view(np.int64))
                    d.append(np.full(len(at), k, np.int64))
                    p.append(at)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (a, d, p)], names=["anchor", "doc_id", "at"])

    return _long(docs, least).mapInArrow(run, "anchor bigint, doc_id bigint, at bigint")


def _long(docs: DataFrame, least: int) -> DataFrame:
    return docs.where("doc_id is not null and length(text) >= %d" % least).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def shared_regions(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """Materialized (anchor, doc_id, at, region, region_id): the surroundings of the anchors that occur in at least two documents.

    A region reaches ``least - window`` characters to both sides of its anchor: enough to tell whether the span around it
    is long enough, whatever lies beyond. Texts are hashed once; only those with a shared anchor are read again, and cut.
    """
    reach = least - window
    found = materialize(anchors(docs, least, window))
    hot = materialize(found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z")).where("_a < _z").select("anchor"))
    shared = materialize(found.join(small(hot), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at")).alias("cuts")))
    release(found)

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for k, t, cuts in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for c in cuts:
                    begin = max(0, c["at"] - reach)
                    for col, x in zip(cols, (c["anchor"], k, begin, t[begin : c["at"] + window + reach])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()])], names=["anchor", "doc_id", "at", "region"])

    rows = _long(docs, least).join(small(shared), "doc_id").select("doc_id", "text", "cuts")
    return materialize(rows.mapInArrow(run, "anchor bigint, doc_id bigint, at bigint, region string").withColumn("region_id", F.xxhash64("region")))


def matches(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(anchor, region_id, other_id, begin, end): distinct regions of one anchor that share a span, and where in the first.

    A region always matches itself (other_id = region_id), with its whole length. Both orders are given.
    """
    distinct = found.groupBy("anchor", "region_id").agg(F.first("region").alias("region"))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("_n"))
    single = distinct.join(sizes.where("_n = 1"), "anchor", "left_semi")
    alone = single.select("anchor", "region_id", F.col("region_id").alias("other_id"), F.lit(0).alias("begin"), F.length("region").alias("end"))
    many = distinct.join(sizes.where("_n > 1").withColumn("_p", F.ceil(F.col("_n") / SHARD)).withColumn("_q", F.ceil(F.col("_n") / (10 * SHARD))), "anchor")
    piece = F.pmod(F.xxhash64("region_id", F.lit(3)), F.col("_p"))
    reference = many.select("anchor", piece.alias("_s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_q") - 1)).alias("_t"), "region_id", "region", F.lit(True).alias("ref"))
    others = many.where("_p > 1").select("anchor", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p") - 1)).alias("_s"), piece.alias("_own"), F.pmod(F.xxhash64("region_id", F.lit(5)), F.col("_q")).alias("_t"), "region_id", "region").where("_s <> _own").drop("_own").withColumn("ref", F.lit(False))
    shards = (
        reference.unionByName(others)
        .groupBy("anchor", "_s", "_t")
        .agg(F.array_sort(F.collect_list(F.when(F.col("ref"), F.struct("region_id", "region")))).alias("refs"), F.array_sort(F.collect_list(F.when(~F.col("ref"), F.struct("region_id", "region")))).alias("streams"))
    )
    schema = "anchor bigint, region_id bigint, other_id bigint, begin int, end int"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                refs = r["refs"]
                sam = SuffixAutomaton([x["region"] for x in refs])
                for x in ([] if r["_t"] else refs) + r["streams"]:
                    best: dict[int, tuple[int, int]] = {}
                    for end, n, state in sam.stream(x["region"], least):
                        for t in sam.texts_of(state):
                            if t not in best:
                                best[t] = (end - least, end)
                            elif best[t][1] == end - 1:
                                best[t] = (best[t][0], end)
                    for t, (a, z) in best.items():
                        rows.append((r["anchor"], x["region_id"], refs[t]["region_id"], a, z))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["anchor", "region_id", "other_id", "begin", "end"])

    return alone.unionByName(shards.select("anchor", "_t", "refs", "streams").mapInArrow(run, schema))


def sharing_pairs(found: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct (doc_a, doc_b), doc_a < doc_b, with a common span of the required length."""
    where = found.select("anchor", "region_id", "doc_id").distinct()
    long = matched.where(F.col("end") - F.col("begin") >= LEAST).select("anchor", "region_id", "other_id").where("region_id <= other_id")
    a = where.select("anchor", "region_id", F.col("doc_id").alias("_x"))
    b = where.select("anchor", F.col("region_id").alias("other_id"), F.col("doc_id").alias("_y"))
    return long.join(a, ["anchor", "region_id"]).join(b, ["anchor", "other_id"]).where("_x <> _y").select(F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b")).distinct()


def shared_parts(found: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, begin, end): maximal stretches of each document that stand in another one too, without forming pairs.

    A region counts when it matches another region, or when two documents hold it.
    """
    held = found.groupBy("anchor", "region_id").agg((F.min("doc_id") < F.max("doc_id")).alias("_two"))
    spans = matched.where(F.col("end") - F.col("begin") >= LEAST).join(held, ["anchor", "region_id"]).where("region_id <> other_id or _two")
    # another region of the same document only is no other record: compare the documents of both sides by their extremes
    docs = found.groupBy("anchor", "region_id").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    spans = spans.join(docs.select("anchor", F.col("region_id").alias("other_id"), F.col("_lo"), F.col("_hi")), ["anchor", "other_id"])
    placed = found.join(spans.select("anchor", "region_id", "begin", "end", "_lo", "_hi"), ["anchor", "region_id"]).where("_lo <> doc_id or _hi <> doc_id")
    return placed.select("doc_id", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end")).distinct()


def merged(parts: DataFrame) -> DataFrame:
    """Union of overlapping or touching stretches per document. A document's stretches are few: anchors are sparse."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("begin", "end")
    flag = parts.withColumn("_new", (F.col("begin") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    return flag.withColumn("_g", F.sum(F.coalesce("_new", F.lit(1))).over(w)).groupBy("doc_id", "_g").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_g")


def cleaned(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, n_removed, text): documents without their ``merged`` stretches, which stand in another document too.

    Every document is kept, also one that is left empty; null texts stay null.
    """
    spans = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_s"))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    # what stands between one stretch and the next: from the end of each, or the beginning, to the next begin, or the end
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_s", lambda s: s["end"].cast("bigint")))
    ends = F.concat(F.transform("_s", lambda s: s["begin"].cast("bigint")), F.array(F.length("text").cast("bigint")))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(F.col("text"), (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int"))), "")
    text = F.when(F.col("_s").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    return rows.withColumn("_t", text).select("doc_id", F.coalesce(F.length("text") - F.length("_t"), F.lit(0)).cast("bigint").alias("n_removed"), F.col("_t").alias("text"))
