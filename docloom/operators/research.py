"""Iterative retrieval and alignment of chunks with the blocks they came from."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize


def research(start: DataFrame, retrieve: Callable[[DataFrame], DataFrame], next_queries: Callable[[DataFrame], DataFrame], rounds: int = 6) -> DataFrame:
    """(query_id, chunk_id, round): chunks found over up to ``rounds`` rounds, each chunk with the first that found it.

    ``next_queries`` is injected (a model): it maps new hits to new queries; queries asked before are dropped, and
    the loop ends when none is left.
    """
    asked, queries, found = start, start, None
    for i in range(rounds):
        hits = materialize(retrieve(queries).select("query_id", "chunk_id").withColumn("round", F.lit(i)))
        new = hits if found is None else hits.join(found, ["query_id", "chunk_id"], "left_anti")
        found = new if found is None else found.unionByName(new)
        queries = materialize(next_queries(new).select(*start.columns).distinct().join(asked, start.columns, "left_anti"))
        if queries.isEmpty():
            break
        asked = asked.unionByName(queries)
    return found


def shortened_reasoning(steps: list[str], marks: tuple[str, ...] = ("search", "result")) -> list[str]:
    """First, last four and those steps that bear a search; '...' for what is left out."""
    keep = [i == 0 or i >= len(steps) - 4 or any(m in s.lower() for m in marks) for i, s in enumerate(steps)]
    out: list[str] = []
    for s, k in zip(steps, keep):
        if k:
            out.append(s)
        elif not out or out[-1] != "...":
            out.append("...")
    return out


def align(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, block_ids): blocks of a document that a chunk's text contains, each block used once, in order.

    chunks: doc_id, chunk_no, chunk_id, text; blocks: doc_id, block_no, block_id, text. A cursor runs over the blocks of one document;
    documents are independent and of bounded size each.
    """
    c = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "text"))).alias("c"))
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "text"))).alias("b"))

    def run(batches):
        for batch in batches:
            ids, got = [], []
            for cs, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for x in cs:
                    text, mine = " ".join((x["text"] or "").split()), []
                    k = at
                    while k < len(bs):
                        t = " ".join((bs[k]["text"] or "").split())
                        if t and t in text:
                            mine.append(bs[k]["block_id"])
                            at = k + 1
                        elif mine and t:
                            break
                        k += 1
                    ids.append(x["chunk_id"])
                    got.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(got, pa.list_(pa.string()))], names=["chunk_id", "block_ids"])

    return c.join(b, "doc_id").select("c", "b").mapInArrow(run, "chunk_id string, block_ids array<string>")
