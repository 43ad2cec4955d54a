"""Structured Streaming: monotone progress, idempotent upserts, windows with late data, retries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.mutation import upsert
from docloom.runtime import shared_dir


def monotone_progress(events: DataFrame, key: str, progress: str) -> DataFrame:
    """Progress that never falls; -1 is final. One small state row per key, for batch and stream alike."""
    worst = F.min(progress)
    return events.groupBy(key).agg(F.when(worst < 0, F.lit(-1.0)).otherwise(F.max(progress)).alias("progress"))


def retried(tasks: DataFrame, key: str, failed: str, most: int = 3) -> DataFrame:
    """Tasks with their failures; 'abandoned' from ``most`` on."""
    n = tasks.groupBy(key).agg(F.sum(F.col(failed).cast("int")).alias("failures"))
    return n.withColumn("state", F.when(F.col("failures") >= most, "abandoned").when(F.col("failures") > 0, "retry").otherwise("ok"))


def windows(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts with a watermark, to be run in append mode: a window is given once, when the latest time seen is ``late`` past its end, and
    rows that come later still are left out by the engine. (In complete mode all state is kept and nothing is left out.)"""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its last result, through a table in the shared folder."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{where}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def upsert_into(path: str, key: str, version: str):
    """foreachBatch sink: last write wins per key. Each epoch adds what it brought, under its own name, so that a replayed batch replaces
    itself and nothing that is there already is written again. Read with ``upserted``."""

    def write(batch: DataFrame, epoch: int) -> None:
        upsert(batch.where("false"), batch, key, version).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def upserted(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The last version of each key over all epochs."""
    rows = spark.read.parquet(path).drop("epoch")
    return upsert(rows.where("false"), rows, key, version)


def compacted(spark: SparkSession, path: str, to: str, key: str, version: str) -> None:
    """Write the present state as one epoch of a new path, from time to time, so that reading stays cheap."""
    upserted(spark, path, key, version).write.mode("overwrite").parquet(f"{to}/epoch=0")


def files_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table of the data directory, one file or a folder of them, as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return stream.parquet(path)
    # the engine streams folders only
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
