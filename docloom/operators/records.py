"""Records around the documents: people, sessions, grants, previews, queues, expiry, indexes, benchmark files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.metadata import listing
from docloom.operators.retrieval import highlight

#: Endings of columns that serve the index only.
INDEXED = ("_vec", "_sm_tks", "_sm_ltks", "_tks", "_ltks")
#: Most rows that a sequential listing of one document gives.
SEQUENCE = 1024


def without_indexed(df: DataFrame, endings: tuple[str, ...] = INDEXED) -> DataFrame:
    """Drop the columns that only serve the index: vectors and token strings."""
    return df.drop(*[c for c in df.columns if c.endswith(endings)])


def people(df: DataFrame, like: dict[str, str], order: list[Column], page: int = 1, size: int = 30) -> DataFrame:
    """A page of the rows whose columns contain the given texts, letter case aside, with the total beside; blank texts filter nothing."""
    for name, text in like.items():
        if text:
            df = df.where(F.lower(F.col(name)).contains(text.lower()))
    return listing(df, order, page, size)


def assignable(everyone: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Those who are not members yet."""
    return everyone.join(members.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def sessions(df: DataFrame, order: list[Column], page: int = 1, size: int = 30, keyword: tuple[str, str] | None = None, since: Column | None = None, until: Column | None = None, time: str = "create_time", drop: tuple[str, ...] = ()) -> DataFrame:
    """A page of sessions and the total: by keyword (column, text) and by time, both ends included; heavy columns may be left out."""
    if keyword and keyword[1]:
        df = df.where(F.lower(F.col(keyword[0])).contains(keyword[1].lower()))
    if since is not None:
        df = df.where(F.col(time) >= since)
    if until is not None:
        df = df.where(F.col(time) <= until)
    return listing(df.drop(*drop), order, page, size)


def page_then_time(df: DataFrame, order: list[Column], page: int, size: int, since: Column, time: str = "create_time") -> DataFrame:
    """The rows of a page that are not older than ``since``: filtered after paging, so a page may come out short."""
    return listing(df, order, page, size).where(F.col(time) >= since)


def field_maps(df: DataFrame, key: str, config: str, version: str) -> DataFrame:
    """(key, field, value): union of the JSON objects of a group; of fields that several have, the latest version's value. Unreadable ones are left out."""
    entries = df.where(F.col(key).isNotNull()).select(key, F.col(version).alias("_v"), F.explode(F.from_json(config, "map<string,string>")).alias("field", "value"))
    return entries.groupBy(key, "field").agg(F.max(F.struct("_v", "value")).alias("_b")).select(key, "field", F.col("_b.value").alias("value"))


def grants(users: DataFrame, teams: DataFrame, names: DataFrame) -> DataFrame:
    """(resource_id, holder_kind, holder_id, name, permission): what users and teams hold, with their names; unknown holders have none."""
    both = users.select("resource_id", F.lit("user").alias("holder_kind"), F.col("user_id").cast("string").alias("holder_id"), "permission").unionByName(
        teams.select("resource_id", F.lit("team").alias("holder_kind"), F.col("team_id").cast("string").alias("holder_id"), "permission")
    )
    return both.distinct().join(names.select("holder_kind", "holder_id", "name"), ["holder_kind", "holder_id"], "left")


def granted(current: DataFrame, arrived: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Grants after an upsert: one per key columns, the greatest version; of equal ones the arrived one."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), "_new", *[F.col(c).alias(f"_c_{c}") for c in rest])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b._c_{c}").alias(c) for c in rest]).select(*current.columns)


def preview(chunks: DataFrame, page: int, text: str, words: list[str]) -> DataFrame:
    """Chunks of one page of a document, with the sentences that hold a word marked; those without one keep their text."""
    return chunks.where(F.array_contains("page_num_int", page)).withColumn("preview", F.coalesce(highlight(text, words), F.col(text)) if words else F.col(text))


def sequence(chunks: DataFrame, doc: str, *order: Column, most: int = SEQUENCE) -> DataFrame:
    """The first ``most`` chunks of each document, in order, with their place."""
    w = Window.partitionBy(doc).orderBy(*order)
    return chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pending(tasks: DataFrame, events: DataFrame, now: Column, idle: int) -> DataFrame:
    """(task_id, delivery): tasks of a queue to hand out now. ``events``: task_id, kind ('taken', 'done', 'cancelled'), at.

    A task is handed out until it is done or cancelled: at first, and again ``idle`` seconds after it was last taken.
    """
    per = events.groupBy("task_id").agg(F.max(F.when(F.col("kind") == "taken", F.col("at"))).alias("_t"), F.count_if(F.col("kind") == "taken").alias("_n"), F.max(F.col("kind").isin("done", "cancelled")).alias("_x"))
    rows = tasks.select("task_id").distinct().join(per, "task_id", "left").where(~F.coalesce("_x", F.lit(False)))
    waiting = F.col("_t").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("_t") >= idle)
    return rows.where(waiting).select("task_id", (F.coalesce("_n", F.lit(0)) + 1).alias("delivery"))


def unexpired(entries: DataFrame, key: str, at: str, now: Column, seconds: int, removed: DataFrame | None = None) -> DataFrame:
    """The last entry of each key that is younger than ``seconds`` and was not removed since."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), at).alias("_e")).select(key, "_e.*").where(F.unix_timestamp(now) - F.unix_timestamp(at) < seconds)
    if removed is None:
        return last
    gone = removed.groupBy(key).agg(F.max("at").alias("_gone"))
    return last.join(gone, key, "left").where(F.col("_gone").isNull() | (F.col(at) > F.col("_gone"))).drop("_gone")


class Index:
    """A named table of a catalog as the store of one tenant: created, tested, migrated and dropped by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, schema: str, partition_by: tuple[str, ...] = ()) -> bool:
        """True where it was not there before."""
        if self.exists():
            return False
        by = f" partitioned by ({', '.join(partition_by)})" if partition_by else ""
        self.spark.sql(f"create table {self.name} ({schema}) using parquet{by}")
        return True

    def migrate(self, columns: dict[str, str]) -> list[str]:
        """Add the columns that are missing; older rows have nulls there. Returns what was added."""
        have = set(self.spark.table(self.name).columns)
        new = {c: t for c, t in columns.items() if c not in have}
        if new:
            self.spark.sql(f"alter table {self.name} add columns ({', '.join(f'{c} {t}' for c, t in new.items())})")
        return sorted(new)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def trivia_passages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, qrels) of question rows (question_id, answer aliases, passages with doc_id, text): a passage that holds an alias is relevant."""
    rows = df.select("question_id", F.transform("aliases", lambda a: F.lower(a)).alias("_a"), F.explode("passages").alias("p"))
    docs = rows.select(F.col("p.doc_id").alias("doc_id"), F.col("p.text").alias("text")).dropDuplicates(["doc_id"])
    hit = F.exists("_a", lambda a: (a != "") & F.contains(F.lower(F.coalesce(F.col("p.text"), F.lit(""))), a))
    return docs, rows.select(F.col("question_id").alias("query_id"), F.col("p.doc_id").alias("doc_id"), F.coalesce(hit, F.lit(False)).cast("int").alias("relevance"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of a judgment file: query, iteration, document and relevance between tabs."""
    return spark.read.csv(path, sep="\t", schema="query_id string, iteration string, doc_id string, relevance int").drop("iteration")


def write_report(per_query: DataFrame, run: DataFrame, qrels: DataFrame, folder: str) -> None:
    """Per-query measures, and run and judgments as JSON by query."""
    per_query.orderBy("query_id").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/report")
    for name, df, value in (("run", run, "score"), ("qrels", qrels, "relevance")):
        df.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), value))).alias("docs")).write.mode("overwrite").json(f"{folder}/{name}")


def with_model_scores(rows: DataFrame, score: Callable[[Column, Column], Column], token_weight: float = 0.7, model_weight: float = 0.3) -> DataFrame:
    """Re-rank by a model: ``score`` (injected, a column function or Pandas UDF of query and text) beside token similarity and rank feature.

    ``rows``: query, text, tokensim, feature; nulls count 0.
    """
    near = F.coalesce("tokensim", F.lit(0.0)) + F.coalesce("feature", F.lit(0.0))
    return rows.withColumn("score", token_weight * near + model_weight * F.coalesce(score(F.col("query"), F.col("text")), F.lit(0.0)))


def with_fallback_tags(rows: DataFrame, tag: Callable[[Column], Column], tags: str = "tag_kwd", text: str = "text") -> DataFrame:
    """Rows without tags get those of ``tag`` (injected, a model); others keep theirs."""
    return rows.withColumn(tags, F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.col(tags)).otherwise(tag(F.col(text))))


def mixed_vectors(title: Column, content: Column, share: float = 0.1) -> Column:
    """Vector of a chunk: ``share`` of its document's title and the rest of its own text; where one is null, the other."""
    mix = F.zip_with(title, content, lambda a, b: share * a.cast("double") + (1 - share) * b.cast("double"))
    return F.coalesce(mix, content.cast("array<double>"), title.cast("array<double>"))


def embedding_input(questions: Column, content: Column) -> Column:
    """Text to embed: a chunk's questions, line by line, where it has any, else its content."""
    some = F.filter(F.coalesce(questions, F.array().cast("array<string>")), lambda q: F.trim(q) != "")
    return F.when(F.size(some) > 0, F.array_join(some, "\n")).otherwise(content)


def enriched(chunks: DataFrame, text: str = "text", **models: Callable[[Column], Column]) -> DataFrame:
    """Add what injected models make of each distinct text (keywords, questions, tags): each text is asked once, whatever the number of chunks that hold it.
    Null texts get null."""
    asked = chunks.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    made = asked.select("_text", *[f(F.col("_text")).alias(n) for n, f in models.items()])
    return chunks.drop(*models).join(made, F.col(text) == F.col("_text"), "left").drop("_text")


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """An external database as a source. With a numeric ``column`` and its bounds the rows are read by that many tasks; filters and columns are
    pushed down by Spark."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
