"""Tag engine: priors and smoothed-lift scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 1000


def counts(rows: DataFrame, tag: str = "tag") -> DataFrame:
    return rows.groupBy(tag).agg(F.count("*").alias("n"))


def prior(rows: DataFrame, smooth: int = SMOOTH, tag: str = "tag") -> DataFrame:
    """(tag, prior): (count + 1) / (sum of counts + smooth)."""
    n = counts(rows, tag)
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t")))).select(tag, ((F.col("n") + 1) / (F.col("_t") + smooth)).alias("prior"))


def lift(matched: DataFrame, priors: DataFrame, keys: list[str], smooth: int = SMOOTH, top: int = 3, floor: Column | None = None) -> DataFrame:
    """(keys, tag, score): tags of matched rows by their lift over the prior, rounded half to even; scores of 0 are dropped.

    matched: keys and tag, one row per matched record and tag. ``floor`` is the least score (1 for queries).
    """
    from pyspark.sql import Window

    per = matched.groupBy(*keys, "tag").agg(F.count("*").alias("c"))
    total = per.groupBy(*keys).agg(F.sum("c").alias("_cnt"))
    raw = 0.1 * (F.col("c") + 1) / (F.col("_cnt") + smooth) / F.greatest(F.lit(1e-6), F.coalesce("prior", F.lit(1e-4)))
    score = F.bround(raw, 0).cast("bigint")
    out = per.join(total, keys).join(priors, "tag", "left").withColumn("_raw", F.round(raw, 9)).withColumn("score", F.greatest(score, floor) if floor is not None else score)
    w = Window.partitionBy(*keys).orderBy(F.col("_raw").desc(), "tag")
    return out.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= top) & (F.col("score") > 0)).select(*keys, F.regexp_replace("tag", r"\.", "_").alias("tag"), "score")
