"""p4: oversized blocks cut into pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.blocks import blocks, settings, with_settings
from docloom.llm.splitting import cut_points, may_exceed, of_oversized, pieces
from docloom.runtime import materialize


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_settings(blocks(spark, sf_dir, "document_id", "text"), settings(spark, sf_dir))
    return rows.where(may_exceed(F.col("text"), F.col("limit"))).select(F.col("block_id").alias("item"), "text", "limit", "overlap")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that are cut: each has at least two pieces."""
    points = cut_points(of_oversized(materialize(_items(spark, sf_dir))))
    return points.where("piece_no = 1").select(F.col("item").alias("block_id"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(materialize(_items(spark, sf_dir))).select(F.col("item").alias("block_id"), "piece_no", "start", "new", "end", "n_tokens", "text")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": r"""
    with c as (select document_id, chunk_token_num, row_number() over (partition by document_id order by create_time desc nulls last, config_id desc) as rn from chunking_config),
    b as (select block_id, document_id, text, row_number() over (partition by block_id order by ingested_at desc nulls last) as rn from content_list where block_id is not null)
    select block_id from b left join (select * from c where rn = 1) c using (document_id)
    where b.rn = 1 and len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[^\s\x{4e00}-\x{9fff}]+'))
      > case when chunk_token_num between 50 and 2048 then chunk_token_num else 256 end"""
}
