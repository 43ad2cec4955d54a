"""Orphan references: keys that name records which are missing, deleted or created later.

Parent keys are read as integers with a text prefix, sorted and compressed into contiguous runs;
distinct references are matched as-of to the run that starts at or before them and are orphans
when they lie beyond its end. Runs never cross a block of ``2**BLOCK_BITS`` consecutive integers,
so the as-of match is a window over a bounded block, never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import runtime
from docloom.runtime import materialize, skewed_join

BLOCK_BITS = 16


def encode_key(col: Column) -> list[Column]:
    """Split a key, without loss, into (prefix, block, offset): its last 15 hex digits form the integer.

    A key that does not end in a hex digit keeps its whole text as prefix. The prefix carries the
    number of digits taken, so 'a01' and 'a1' stay different. Null stays null.
    """
    tail = F.regexp_extract(col, "[0-9a-f]{1,15}$", 0)
    number = F.when(tail == "", F.lit(0)).otherwise(F.conv(tail, 16, 10).cast("bigint"))
    prefix = F.concat(F.length(tail).cast("string"), F.lit(":"), F.substring(col, F.lit(1), F.length(col) - F.length(tail)))
    return [prefix.alias("prefix"), F.shiftright(number, BLOCK_BITS).alias("block"), number.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("off")]


def key_runs(parents: DataFrame, key: str = "key") -> DataFrame:
    """Compress distinct keys into runs (prefix, block, run_start, run_end) of consecutive integers."""
    keys = parents.where(F.col(key).isNotNull()).select(*encode_key(F.col(key))).distinct()
    order = Window.partitionBy("prefix", "block").orderBy("off")
    return (
        keys.withColumn("_island", F.col("off") - F.row_number().over(order))
        .groupBy("prefix", "block", "_island")
        .agg(F.min("off").alias("run_start"), F.max("off").alias("run_end"))
        .drop("_island")
    )


def missing_keys(refs: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """Distinct ``key`` values of ``refs`` that lie in no run (as-of match to the preceding run start)."""
    probe = refs.where(F.col(key).isNotNull()).select(key).distinct().select(key, *encode_key(F.col(key)))
    both = probe.select("prefix", "block", F.col("off").alias("at"), F.lit(1).alias("is_ref"), key, F.lit(None).cast("int").alias("run_end")).unionByName(
        runs.select("prefix", "block", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), F.lit(None).cast("string").alias(key), "run_end")
    )
    asof = Window.partitionBy("prefix", "block").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("_end", F.last("run_end", ignorenulls=True).over(asof)).where("is_ref = 1")
    return matched.where(F.col("_end").isNull() | (F.col("at") > F.col("_end"))).select(key)


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Report references without a valid target.

    ``refs``: table_name, record_id, field_name, target, key, created (key null or blank: no reference).
    ``parents``: target, key, deleted (boolean, null counts as false), created. Keys must be unique per
    target; repeated ones are reduced to the earliest creation and to deleted only when all are.
    Returns table_name, record_id, field_name, reason, period, one row per distinct fault. A reference
    or target without a creation time is never late; its period is null.

    References are first reduced to one row per (target, key), so a key that a third of all rows share
    costs one row in the match. Only faulty keys go back to the rows, salted against such a key.
    """
    refs = refs.select("table_name", "record_id", "field_name", "target", "key", "created").where(F.col("key").isNotNull() & (F.col("key") != "")).withColumn("_k", F.concat_ws("/", "target", "key"))
    parents = (
        parents.where(F.col("key").isNotNull())
        .groupBy("target", "key")
        .agg(F.min(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.min("created").alias("made"))
        .withColumn("_k", F.concat_ws("/", "target", "key"))
    )
    used = materialize(refs.groupBy("_k").agg(F.min("created").alias("first_use"), F.count("*").alias("_n")))
    gone = missing_keys(used.drop("_n"), key_runs(parents, "_k"), "_k").withColumn("state", F.lit("missing")).withColumn("made", F.lit(None).cast("timestamp_ntz"))
    faulty = (
        used.join(parents.select("_k", "deleted", "made"), "_k")
        .where(F.col("deleted") | (F.col("made") > F.col("first_use")))
        .select("_k", F.when(F.col("deleted"), "deleted").otherwise("late").alias("state"), F.col("made").cast("timestamp_ntz"))
        .unionByName(gone.select("_k", "state", "made"))
    )
    hits = skewed_join(refs, faulty, "_k", "record_id", used.where(F.col("_n") > runtime.HOT_ROWS).select("_k", "_n"))
    return (
        hits.where((F.col("state") != "late") | (F.col("made") > F.col("created").cast("timestamp_ntz")))
        .select("table_name", "record_id", "field_name", F.col("state").alias("reason"), F.date_format("created", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return orphans.groupBy("table_name", "field_name", "reason", "period").agg(F.count("*").alias("n_references"))
