"""Views of the block tables that several problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import latest, table

LIMIT, LOW, HIGH = 256, 50, 2048


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, limit, min_tokens, overlap): the setting in force, one row per document.

    A chunk_token_num that is null or outside 50-2048 counts as 256; an unusable minimum or ratio as 0.
    """
    rows = table(spark, sf_dir, "chunking_config").where("document_id is not null")
    now = latest(rows.select("document_id", "config_id", "chunk_token_num", "min_chunk_tokens", "overlap_ratio", "create_time"), ["document_id"], [F.col("create_time"), F.col("config_id")])
    limit = F.when(F.col("chunk_token_num").between(LOW, HIGH), F.col("chunk_token_num")).otherwise(F.lit(LIMIT))
    least = F.when(F.col("min_chunk_tokens").between(0, limit), F.col("min_chunk_tokens")).otherwise(F.lit(0))
    ratio = F.when((F.col("overlap_ratio") >= 0) & (F.col("overlap_ratio") < 1), F.col("overlap_ratio")).otherwise(F.lit(0.0))
    return now.select("document_id", limit.alias("limit"), least.alias("min_tokens"), ratio.alias("overlap"))


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """content_list with each block once: its last delivery. Rows without block_id are dropped."""
    chosen = list(dict.fromkeys(["block_id", *columns]))
    rows = table(spark, sf_dir, "content_list").where("block_id is not null").select(*chosen, F.col("ingested_at").alias("_at"))
    return latest(rows, ["block_id"], [F.col("_at")]).drop("_at")


def with_settings(rows: DataFrame, conf: DataFrame) -> DataFrame:
    """Rows with the limit, minimum and overlap of their document; 256, 0 and 0 where it has no setting."""
    out = rows.join(conf, "document_id", "left")
    return out.withColumns({"limit": F.coalesce("limit", F.lit(LIMIT)), "min_tokens": F.coalesce("min_tokens", F.lit(0)), "overlap": F.coalesce("overlap", F.lit(0.0))})
