"""Lineage cuts, size checks and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[object, str]] = []
_CHOSEN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Folder every executor can reach, for written tables.

    ``folder``, where given, is used by this application from now on; else the one that ``spark.checkpoint.dir`` names. Where that is unset too,
    a session whose master is local gets a folder of its own; on a cluster it is an error, since no machine's own disk is shared.
    """
    app = spark.sparkContext.applicationId
    if folder:
        _CHOSEN[app] = folder
    where = _CHOSEN.get(app) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _MADE.append(tempfile.mkdtemp(prefix="docloom-"))
        where = _CHOSEN[app] = f"file://{_MADE[-1]}"
    return where.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a lineage cut that survives executor loss.

    Unlike ``checkpoint()`` the plan is run once, columns stay prunable, and the planner knows the size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # what was shuffled for it is behind the cut; otherwise it would stay on disk until the driver's garbage collector meets it
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that no later plan reads."""
    path = getattr(df, "_docloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the gateway is gone
            break
    for made in _MADE:
        shutil.rmtree(made, ignore_errors=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact file sizes for scans of materialized frames."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


BROADCAST_BYTES = 32 << 20


#: Nodes of a plan that may hand on more bytes than they read, so that no estimate above them is a bound.
_SWELLING = re.compile(r"\b(?:MapInArrow|MapInPandas|FlatMap\w*|ArrowEvalPython\w*|BatchEvalPython\w*|Generate|Expand|\w*Join|Union|LogicalRDD|ExternalRDD|Range)\b")


def bounded(df: DataFrame) -> bool:
    """Whether the plan's size estimate is a bound: files, filtered, projected or aggregated, but nothing that swells them."""
    return not _SWELLING.search(df._jdf.queryExecution().optimizedPlan().toString())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the plan proves a size of at most ``limit``, or is a materialized frame of it.

    Beyond that, and above Python functions, generators and joins, whose output no estimate bounds, the join shuffles; adaptive
    execution still turns it into a broadcast once the size of that shuffle is known.
    """
    return F.broadcast(df) if bounded(df) and plan_bytes(df) <= limit else df


#: Rows of one key that a join leaves to one task.
HOT_ROWS = 1 << 20


def skewed_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """Inner join to ``right``, which is unique in ``key``. ``hot`` (key, _n) has the keys with more than HOT_ROWS rows of ``left`` and their counts:
    those rows are dealt by ``spread`` over as many tasks as they need, and the row they meet goes to each of them.

    There are at most as many hot keys as HOT_ROWS goes into the rows, so ``hot`` is small at any size.
    """
    if hot.isEmpty():
        return left.join(right, key)
    marked = small(materialize(hot.select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_salts"))))
    dealt = left.join(marked, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = right.join(marked, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """Add the place of each row, from 1 on, in the order of the columns, without one task for all: rows are dealt by ranges of the order, numbered
    inside, and moved by what stands before. Rows equal in all order columns stand in any order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = materialize(dealt.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_c"))
    before = materialize(sizes.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c"))  # a row per partition
    return kept.join(small(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order`` (ties beyond it broken by the whole row).

    An aggregate, not a window, so hot keys combine before the shuffle. Null keys form one group.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._v{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)
