"""p1: blocks of a document packed into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.blocks import blocks, settings, with_settings
from docloom.llm.packing import collections, containers, pack_shards
from docloom.llm.tokens import with_run_count
from docloom.runtime import materialize


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir, "document_id", "block_no", "text").where("document_id is not null and trim(document_id) <> ''")
    sized = with_settings(with_run_count(rows, "text"), settings(spark, sf_dir))
    return sized.select(F.col("document_id").alias("collection"), F.col("block_id").alias("item"), F.col("block_no").alias("position"), "size", F.col("limit").alias("cap"), F.col("min_tokens").alias("least"), "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose chunks, as p1_chunks emits them, are fewer than filling in reading order gives."""
    return collections(materialize(pack_shards(materialize(_items(spark, sf_dir))))).where("fewer").select(F.col("collection").alias("document_id"))


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their block ids and fill; a block above the limit is a chunk of its own, to be split by p4."""
    items = materialize(_items(spark, sf_dir))
    shards = materialize(pack_shards(items))
    rows = containers(shards, items, materialize(collections(shards)))
    over = items.where("collection is not null and size > cap").select("collection", F.concat(F.lit("o-"), "item").alias("container"), "item", "size", "cap")
    return (
        rows.unionByName(over)
        .groupBy("collection", "container")
        .agg(F.array_sort(F.collect_list("item")).alias("block_ids"), F.sum("size").cast("bigint").alias("n_tokens"), F.round(F.sum("size") / F.max("cap"), 6).alias("fill"))
        .withColumnRenamed("collection", "document_id")
    )


QUERIES = {"p1_found": p1_found, "p1_chunks": p1_chunks}
SQL: dict[str, str] = {}
