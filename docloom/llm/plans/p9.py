"""p9: long passages that stand verbatim in more than one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.spans import cleaned, matches, merged, shared_parts, shared_regions, sharing_pairs
from docloom.runtime import materialize, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = shared_regions(_docs(spark, sf_dir))
    return found, materialize(matches(found))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_pairs(*_matched(spark, sf_dir))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches per document that stand elsewhere too, with their text."""
    parts = merged(shared_parts(*_matched(spark, sf_dir)))
    return parts.join(_docs(spark, sf_dir), "doc_id").select("doc_id", "begin", "end", F.md5(F.substring("text", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))).alias("passage_md5"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: characters that stand elsewhere too, in spans of the required length."""
    parts = merged(shared_parts(*_matched(spark, sf_dir))).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared_chars"), F.count("*").alias("n_passages"))
    size = F.coalesce(F.length("text"), F.lit(0))
    return (
        table(spark, sf_dir, "documents").select("doc_id", size.alias("n_chars")).join(parts, "doc_id", "left")
        .select("doc_id", F.coalesce("shared_chars", F.lit(0).cast("bigint")).alias("shared_chars"), F.coalesce("n_passages", F.lit(0).cast("bigint")).alias("n_passages"),
                F.round(F.coalesce(F.col("shared_chars") / F.nullif("n_chars", F.lit(0)), F.lit(0.0)), 6).alias("share"))
    )


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand elsewhere too."""
    docs = _docs(spark, sf_dir)
    return cleaned(docs, merged(shared_parts(*_matched(spark, sf_dir)))).select("doc_id", "n_removed", F.md5("text").alias("text_md5"))


_WINDOWS = "w as (select distinct doc_id, unnest(list_transform(range(1, length(text) - 298), lambda p: substr(text, p, 300))) as s from documents where length(text) >= 300)"
_STRETCHES = """w as (select doc_id, unnest(range(1, length(text) - 298)) as p, text from documents where length(text) >= 300),
    h as (select doc_id, p, md5(substr(text, p::int, 300)) as s from w),
    m as (select s from h group by s having count(distinct doc_id) > 1),
    c as (select doc_id, p from h where s in (select s from m)),
    g as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 300 then 1 else 0 end as brk from c),
    i as (select doc_id, p, sum(brk) over (partition by doc_id order by p) as k from g),
    u as (select doc_id, k, min(p) - 1 as start, max(p) + 299 as stop from i group by 1, 2)"""
QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages, "p9_shared": p9_shared, "p9_cleaned": p9_cleaned}
SQL = {
    "p9_found": f"with {_WINDOWS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from w a join w b on a.s = b.s and a.doc_id < b.doc_id",
    "p9_shared": f"""with {_STRETCHES},
    d as (select doc_id, sum(stop - start)::bigint as shared_chars, count(*)::bigint as n_passages from u group by 1)
    select d0.doc_id, coalesce(d.shared_chars, 0)::bigint as shared_chars, coalesce(d.n_passages, 0)::bigint as n_passages,
      round(coalesce(d.shared_chars / nullif(length(d0.text), 0), 0), 6) as share
    from documents d0 left join d on d0.doc_id = d.doc_id""",
    "p9_passages": f"""with {_STRETCHES}
    select doc_id, start::bigint as "begin", stop::bigint as "end", md5(substr(text, start::int + 1, (stop - start)::int)) as passage_md5 from u join documents using (doc_id)""",
    "p9_cleaned": f"""with {_STRETCHES}, e as (select doc_id, start, coalesce(lag(stop) over (partition by doc_id order by start), 0) as before from u),
    k as (select doc_id, string_agg(substr(text, before::int + 1, (start - before)::int), '' order by start) as head from e join documents using (doc_id) group by 1),
    z as (select doc_id, max(stop) as z, sum(stop - start) as n from u group by 1)
    select d.doc_id, coalesce(n, 0)::bigint as n_removed, md5(case when z is null then text else head || substr(text, z::int + 1) end) as text_md5 from documents d left join k on d.doc_id = k.doc_id left join z on d.doc_id = z.doc_id""",
}
