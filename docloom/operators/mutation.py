"""Sinks and changes as plans: upserts, conditional updates and deletes, cascades, list encoding, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import latest


def upsert(current: DataFrame, arrived: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins by ``version``; of equal versions the arrived row. Columns the new rows lack become null."""
    both = current.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [F.col(version), F.col("_new")]).drop("_new")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()})


def add_element(df: DataFrame, where: Column, name: str, value: str) -> DataFrame:
    have = F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))
    return update(df, where & ~F.array_contains(have, value), **{name: F.array_append(have, F.lit(value))})


def remove_element(df: DataFrame, where: Column, name: str, value: str) -> DataFrame:
    return update(df, where, **{name: F.array_remove(F.col(name), value)})


def rename_element(df: DataFrame, where: Column, name: str, old: str, new: str) -> DataFrame:
    """Replace an element everywhere; an array that has both keeps one."""
    changed = F.array_distinct(F.transform(F.col(name), lambda x: F.when(x == old, F.lit(new)).otherwise(x)))
    return update(df, where & F.array_contains(F.col(name), old), **{name: changed})


def delete(df: DataFrame, ids: list | None = None, key: str = "id", where: Column | None = None) -> DataFrame:
    """Rows that stay. An empty id list is refused: it never means everything."""
    if ids is None and where is None:
        raise ValueError("a delete needs ids or a condition")
    if ids is not None:
        if not ids:
            raise ValueError("empty id list")
        df = df.where(~F.coalesce(F.col(key).isin(list(ids)), F.lit(False)))
    return df if where is None else df.where(~F.coalesce(where, F.lit(False)))


def remove_documents(chunks: DataFrame, graph: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the chunks of removed documents, strip them from the graph's sources, drop graph rows without a source."""
    keep = chunks.join(gone.select("doc_id"), "doc_id", "left_anti")
    exploded = graph.select(*[c for c in graph.columns if c != "source_id"], F.explode("source_id").alias("doc_id")).join(gone.select("doc_id"), "doc_id", "left_anti")
    keys = [c for c in graph.columns if c != "source_id"]
    return keep, exploded.groupBy(*keys).agg(F.array_sort(F.collect_set("doc_id")).alias("source_id"))


def encode_positions(positions: Column) -> Column:
    """Positions as eight-digit hex numbers joined by underscores."""
    return F.array_join(F.flatten(F.transform(positions, lambda p: F.transform(F.array(p["page"], p["x0"], p["x1"], p["top"], p["bottom"]), lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))))), "_")


def decode_positions(text: Column) -> Column:
    """Inverse of :func:`encode_positions` as rows of five ints; blank text is an empty array."""
    values = F.transform(F.filter(F.split(text, "_"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.when(F.size(values) >= 5, F.transform(F.sequence(F.lit(0), (F.size(values) / 5 - 1).cast("int")), lambda i: F.slice(values, (i * 5 + 1).cast("int"), F.lit(5)))).otherwise(F.array().cast("array<array<int>>"))


def encode_list(values: Column) -> Column:
    return F.array_join(values, "###")


def decode_list(text: Column) -> Column:
    return F.filter(F.split(text, "###"), lambda x: x != "")


def with_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Schema migration: columns that are missing are added as null of their type."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in schema.items() if n not in df.columns})


def write_table(df: DataFrame, path: str, partition_by: list[str], mode: str = "overwrite") -> None:
    """Partition-wise overwrite: partitions that the frame does not hold stay."""
    df.repartition(*partition_by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
