"""p8: documents mixed to the target shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.mixing import allocate, choose, reached, source_sizes
from docloom.llm.tokens import with_token_count
from docloom.runtime import materialize, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("trim(source) <> ''")
    return materialize(with_token_count(docs, "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = allocate(source_sizes(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))
    return plan.where("cannot_reach").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir)
    return choose(sized, allocate(source_sizes(sized), table(spark, sf_dir, "mix_targets")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir)
    plan = allocate(source_sizes(sized), table(spark, sf_dir, "mix_targets"))
    return reached(plan, choose(sized, plan))


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL = {
    "p8_found": r"""
    with d as (select lower(trim(source)) as source, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[^\s\x{4e00}-\x{9fff}]+')) as n from documents where trim(source) <> ''),
    s as (select source, sum(n) as own from d group by 1)
    select lower(trim(t.source)) as source from mix_targets t left join s on lower(trim(t.source)) = s.source
    where t.target_share * (select sum(n) from d) > t.max_repeats * coalesce(s.own, 0)"""
}
