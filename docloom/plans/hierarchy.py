"""p2: folder trees of kb_file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.hierarchy import current_links, descendants, euler_tour, hierarchy, ring_members
from docloom.runtime import materialize, table


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kb_file").select("file_id", "parent_id", "file_name", "update_time")
    return materialize(current_links(rows, "file_id", "parent_id", F.col("update_time"), ["file_name"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_members(links(spark, sf_dir)).select(F.col("node").alias("file_id"), F.col("ring").alias("cycle_id"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy(links(spark, sf_dir), "file_name")
    return out.select(F.col("node").alias("file_id"), F.col("root").alias("root_id"), "depth", "path", "n_descendants", F.col("ring").alias("cycle_id"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = descendants(materialize(euler_tour(links(spark, sf_dir))))
    return pairs.select(F.col("ancestor").alias("file_id"), F.col("descendant").alias("descendant_id"))


_LINKS = """cur as (select file_id, nullif(trim(parent_id), '') as up, file_name,
        row_number() over (partition by file_id order by update_time desc nulls last) as rn from kb_file where file_id is not null),
      l as (select c.file_id, case when p.file_id <> c.file_id then p.file_id end as parent, coalesce(c.file_name, '') as name
        from (select * from cur where rn = 1) c left join (select file_id from cur where rn = 1) p on c.up = p.file_id),
      tree as (select file_id, file_id as root_id, 0 as depth, name as path from l where parent is null
        union all select l.file_id, t.root_id, t.depth + 1, t.path || '/' || l.name from l join tree t on l.parent = t.file_id)"""
_UP = """up(file_id, anc) as (select file_id, parent from l where parent is not null
        union select up.file_id, l.parent from up join l on up.anc = l.file_id where l.parent is not null)"""
_RINGS = "rings as (select u.file_id, min(u.anc) as cycle_id from up u join up s on u.anc = s.file_id and s.anc = s.file_id group by 1)"

QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}
SQL = {
    "p2_found": f"with recursive {_LINKS}, {_UP}, {_RINGS} select file_id, cycle_id from rings",
    "p2_hierarchy": f"""with recursive {_LINKS}, {_UP}, {_RINGS},
      n as (select anc as file_id, count(*) as n from up where file_id in (select file_id from tree) group by 1)
      select t.file_id, root_id, depth, path, coalesce(n.n, 0)::bigint as n_descendants, null::varchar as cycle_id from tree t left join n on t.file_id = n.file_id
      union all select file_id, null, -1, null, -1, cycle_id from rings""",
    "p2_descendants": f"with recursive {_LINKS}, {_UP} select anc as file_id, file_id as descendant_id from up where file_id in (select file_id from tree)",
}
