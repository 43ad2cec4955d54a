"""Mixing sources to target weights by capped water-filling.

Sources are clamped at ``max_repeats`` epochs; the excess weight goes to the others in proportion to
their targets until nothing exceeds its cap. Whole repetitions take every document, the fractional one
takes a seeded random prefix of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import small

#: Hash buckets per source: the fractional prefix is found by bucket sums first, then inside one bucket.
BUCKETS = 4096
#: More target rows than this are refused: the allocation is worked out on the driver.
MAX_SOURCES = 100_000


def source_sizes(sized: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """(source, own, n_docs) with sources trimmed and in lower case; rows with a null or blank source take no part."""
    name = F.nullif(F.lower(F.trim(source)), F.lit(""))
    return sized.select(name.alias("source"), F.coalesce(F.col(size), F.lit(0)).alias("_n")).where("source is not null").groupBy("source").agg(F.sum("_n").alias("own"), F.count("*").alias("n_docs"))


def water(shares: dict[str, float], caps: dict[str, float], total: float) -> tuple[dict[str, float], dict[str, int]]:
    """(sizes, rounds): sizes proportional to ``shares``, none above its cap, summing to ``total`` where the caps allow it.

    A source that the level of a round puts above its cap is clamped there, and the excess raises the level for the others.
    ``rounds`` has the round in which a source was clamped: 0 means that its own target is beyond it, a later one that
    only what others left over is.
    """
    given: dict[str, float] = {}
    rounds: dict[str, int] = {}
    open_, left, k = {s for s, w in shares.items() if w > 0}, total, 0
    while open_:
        level = left / sum(shares[s] for s in open_)
        over = {s for s in open_ if shares[s] * level > caps[s]}
        if not over:
            given.update({s: shares[s] * level for s in open_})
            break
        for s in over:
            given[s], rounds[s] = caps[s], k
            left -= caps[s]
        open_, k = open_ - over, k + 1
    return {s: max(0.0, given.get(s, 0.0)) for s in shares}, rounds


def fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """The sizes of ``water``."""
    return water(shares, caps, total)[0]


def allocate(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: share, cap, allocation, whole epochs and the fractional rest.

    ``total`` is the size of the mix; by default that of all documents with a source. ``cannot_reach`` marks
    sources that are clamped in the first round, at their own target. Null targets and repeats count 0; a target
    listed twice is summed (its larger ``max_repeats`` holds); a source without documents gets nothing.
    """
    spark = sizes.sparkSession
    t = (
        targets.select(F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), "target_share", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("reps"))
    )
    everything = sizes.agg(F.sum("own").alias("everything"))
    rows = t.join(sizes, "source", "left").crossJoin(F.broadcast(everything)).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    own = {r.source: float(r.own or 0) for r in rows}
    all_tokens = float((rows[0].everything if rows else 0) or 0)
    want = all_tokens if total is None else float(total)
    shares = {r.source: float(r.share) for r in rows}
    reps = {r.source: int(r.reps) for r in rows}
    caps = {s: reps[s] * own[s] for s in own}
    given, rounds = water(shares, caps, want)
    out = []
    for s in sorted(own):
        whole = min(reps[s], int(given[s] // own[s])) if own[s] else 0
        out.append((s, shares[s], reps[s], int(own[s]), given[s], whole, given[s] - whole * own[s] if whole < reps[s] else 0.0, rounds.get(s) == 0))
    return spark.createDataFrame(out, "source string, target_share double, max_repeats int, own_tokens bigint, allocated double, whole int, rest double, cannot_reach boolean")


def choose(sized: DataFrame, plan: DataFrame, doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): chosen documents. The fractional epoch takes, in seeded hash order,
    the documents whose running total stays within the rest, so no source exceeds its allocation."""
    name = F.nullif(F.lower(F.trim("source")), F.lit(""))
    docs = sized.select(F.col(doc_id).alias("doc_id"), name.alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(F.broadcast(plan.select("source", "whole", "rest")), "source")
    h = F.xxhash64(F.lit(seed), "doc_id")
    docs = docs.withColumns({"_h": h, "_b": F.pmod(F.shiftrightunsigned(h, 32), F.lit(BUCKETS))})
    sums = docs.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("_run", F.sum("n_tokens").over(inside)).join(small(before), ["source", "_b"])
    extra = ((F.col("_before") + F.col("_run")) <= F.col("rest")).cast("int")
    return placed.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).alias("repeats")).where("repeats > 0")


def reached(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """Actual shares: tokens chosen per source over those of all sources."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    whole = F.sum("actual_tokens").over(Window.partitionBy())
    return plan.join(got, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0).cast("bigint"))).select(
        "source", "target_share", "max_repeats", "own_tokens", F.round("allocated", 3).alias("allocated"), "cannot_reach", "actual_tokens",
        F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.col("actual_tokens") / F.nullif(whole, F.lit(0)), 9).alias("actual_share"),
    )
