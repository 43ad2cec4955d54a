"""p7: eval_items that leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.leakage import leaks, reparameterised
from docloom.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "eval_items").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparameterised(table(spark, sf_dir, "eval_items").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p7_found": p7_found, "p7_reparameterised": p7_reparameterised}
SQL = {
    "p7_found": """
    with i as (select item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as s from eval_items),
    d as (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as s from documents),
    iw as (select item_id, unnest(list_transform(range(1, length(s) - 98), lambda p: substr(s, p, 100))) as w from i where length(s) >= 100),
    dw as (select doc_id, unnest(list_transform(range(1, length(s) - 98), lambda p: substr(s, p, 100))) as w from d where length(s) >= 100)
    select distinct item_id, doc_id from iw join dw using (w)"""
}
