"""Retrieval quality against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, qrels: DataFrame, ndcg_at: int = 10, map_at: int = 5, mrr_at: int = 10) -> DataFrame:
    """One row: mean nDCG, MAP and MRR over queries with hits. run: query_id, doc_id, rank; qrels: query_id, doc_id."""
    rel = run.join(qrels.select("query_id", "doc_id", F.lit(1).alias("rel")), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per = (
        rel.withColumn("hits", hits)
        .groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("rank") <= ndcg_at, F.col("rel") / F.log2(F.col("rank") + 1))).alias("dcg"),
            F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= map_at), F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))).alias("ap"),
            F.max(F.when((F.col("rel") == 1) & (F.col("rank") <= mrr_at), 1.0 / F.col("rank")).otherwise(F.lit(0.0))).alias("rr"),
        )
    )
    total = qrels.groupBy("query_id").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    return per.join(total, "query_id").agg(
        F.round(F.avg(F.col("dcg") / ideal), 6).alias(f"ndcg_{ndcg_at}"), F.round(F.avg(F.col("ap") / F.least("total", F.lit(map_at))), 6).alias(f"map_{map_at}"), F.round(F.avg("rr"), 6).alias(f"mrr_{mrr_at}"), F.count("*").alias("n_queries")
    )
