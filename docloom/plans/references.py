"""p3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import key
from docloom.operators.references import orphan_counts, orphan_references
from docloom.runtime import latest, table

#: (table, record id, field, target)
FIELDS = [
    ("kb_document", "document_id", "kb_id", "knowledgebase"),
    ("chunk_app", "id", "kb_id", "knowledgebase"),
    ("chunk_app", "id", "doc_id", "kb_document"),
    ("content_list", "block_id", "document_id", "kb_document"),
    ("chunking_config", "config_id", "document_id", "kb_document"),
    ("file2document", "link_id", "document_id", "kb_document"),
    ("file2document", "link_id", "file_id", "kb_file"),
]


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in dict.fromkeys(f[0] for f in FIELDS):
        fields = [f for f in FIELDS if f[0] == name]
        rid = fields[0][1]
        rows = table(spark, sf_dir, name).select(rid, *[f[2] for f in fields], "create_time").where(F.col(rid).isNotNull())
        one = rows.select(
            F.lit(name).alias("table_name"),
            F.col(rid).alias("record_id"),
            F.col("create_time").alias("created"),
            F.inline(F.array(*[F.struct(F.lit(f[2]).alias("field_name"), F.lit(f[3]).alias("target"), key(f[2]).alias("key")) for f in fields])),
        )
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "record_id", "field_name", "target", "key", "created")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "knowledgebase").select(F.lit("knowledgebase").alias("target"), key("kb_id").alias("key"), (F.trim("status") == "0").alias("deleted"), F.col("create_time").alias("created"))
    doc = table(spark, sf_dir, "kb_document").select(F.lit("kb_document").alias("target"), key("document_id").alias("key"), (F.trim("status") == "0").alias("deleted"), F.col("create_time").alias("created"))
    files = latest(table(spark, sf_dir, "kb_file").select("file_id", "update_time", "create_time"), ["file_id"], [F.col("update_time")])
    file = files.select(F.lit("kb_file").alias("target"), key("file_id").alias("key"), F.lit(False).alias("deleted"), F.col("create_time").alias("created"))
    return kb.unionByName(doc).unionByName(file)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_refs(spark, sf_dir), _parents(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p3_found(spark, sf_dir))


def _sql_found() -> str:
    refs = " union all ".join(
        f"select distinct '{t}' as table_name, {rid} as record_id, '{f}' as field_name, '{target}' as target, lower(trim({f})) as k, create_time as created from {t} where {rid} is not null and trim(coalesce({f}, '')) <> ''"
        for t, rid, f, target in FIELDS
    )
    return f"""
    with refs as ({refs}),
    files as (select file_id, create_time, row_number() over (partition by file_id order by update_time desc nulls last, create_time desc) as rn from kb_file),
    parents as (
      select 'knowledgebase' as target, lower(trim(kb_id)) as k, coalesce(trim(status) = '0', false) as deleted, create_time as made from knowledgebase
      union all select 'kb_document', lower(trim(document_id)), coalesce(trim(status) = '0', false), create_time from kb_document
      union all select 'kb_file', lower(trim(file_id)), false, create_time from files where rn = 1),
    p as (select target, k, min(deleted) as deleted, min(made) as made from parents where k is not null group by 1, 2),
    judged as (
      select r.table_name, r.record_id, r.field_name, r.created,
        case when p.k is null then 'missing' when p.deleted then 'deleted' when p.made > r.created then 'late' end as reason
      from refs r left join p on r.target = p.target and r.k = p.k)
    select distinct table_name, record_id, field_name, reason, strftime(created, '%Y-%m') as period from judged where reason is not null"""


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p3_found": _sql_found(),
    "p3_counts": f"select table_name, field_name, reason, period, count(*) as n_references from ({_sql_found()}) group by 1, 2, 3, 4",
}
