"""Metadata analytics: filters, listings, roll-ups, permissions, trees, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import small


def where_terms(df: DataFrame, **terms) -> DataFrame:
    """Conjunctive filter: lists mean IN (overlap on array columns), scalars equality, empty values nothing.

    ``available_int=0`` selects what is switched off, any other value what is not: missing counts as on.
    """
    for name, value in terms.items():
        if name == "available_int":
            on = F.coalesce(F.col(name), F.lit(1)) >= 1
            df = df.where(~on if value == 0 else on)
        elif value is None or value == "" or value == []:
            continue
        elif isinstance(value, (list, tuple, set)):
            many = F.array(*[F.lit(v) for v in value])
            array = df.schema[name].dataType.typeName() == "array"
            df = df.where(F.arrays_overlap(F.col(name), many) if array else F.col(name).isin(list(value)))
        elif isinstance(value, (str, int, float)):
            array = df.schema[name].dataType.typeName() == "array"
            df = df.where(F.array_contains(F.col(name), value) if array else F.col(name) == value)
        else:
            raise TypeError(f"{name}: {type(value).__name__} is no filter value")
    return df


def build_query(df: DataFrame, order_by: str | None = None, descending: bool = False, **by) -> DataFrame:
    """Query builder: a two-element list on a number or time column is a range (None leaves an end open), other lists are IN."""
    for name, value in by.items():
        kind = df.schema[name].dataType.typeName()
        if isinstance(value, (list, tuple)) and len(value) == 2 and kind not in ("string", "array"):
            low, high = value
            if low is not None:
                df = df.where(F.col(name) >= F.lit(low))
            if high is not None:
                df = df.where(F.col(name) <= F.lit(high))
        elif isinstance(value, (list, tuple)):
            df = df.where(F.col(name).isin(list(value)))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.col(order_by).desc() if descending else F.col(order_by).asc()) if order_by else df


def in_list(df: DataFrame, name: str, values: DataFrame, value: str) -> DataFrame:
    """A long IN list as a semi join, broadcast while small."""
    return df.join(small(values.select(F.col(value).alias(name)).distinct()), name, "left_semi")


def contains(name: str, text: str) -> Column:
    """Case-insensitive containment."""
    return F.lower(F.col(name)).contains(text.lower())


def exists(name: str, array: bool = False) -> Column:
    return F.col(name).isNotNull() & (F.size(F.col(name)) > 0 if array else F.col(name).cast("string") != "")


def listing(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page with the count of all rows: the total is an aggregate of its own, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def grouped_facets(df: DataFrame, *names: str) -> DataFrame:
    """Counts of several independent facets and of all rows in one pass of grouping sets: (facet, value, n)."""
    rows = df.select(F.explode(F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])).alias("e"))
    return rows.groupBy(F.col("e.facet").alias("facet"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def progress(tasks: DataFrame, doc: str = "doc_id", value: str = "progress", message: str = "message") -> DataFrame:
    """Roll-up of a document's tasks: mean progress with failures as 0, and a state.

    'failed' when all tasks have ended and any failed (-1), 'done' when all succeeded, else 'running'.
    """
    p = F.col(value)
    rolled = tasks.groupBy(doc).agg(
        F.round(F.avg(F.greatest(p, F.lit(0.0))), 6).alias("progress"), F.min(p).alias("_low"), F.bool_and((p >= 1) | (p < 0)).alias("_over"), F.array_join(F.array_sort(F.collect_set(message)), "\n").alias("messages"), F.count("*").alias("n_tasks")
    )
    state = F.when(F.col("_over") & (F.col("_low") < 0), "failed").when(F.col("_over"), "done").otherwise("running")
    return rolled.select(doc, "progress", state.alias("state"), "messages", "n_tasks")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; of equals the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("o"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(value), (-F.col("_m.o")).alias("n"))


def joined_values(df: DataFrame, keys: list[str], value: str, separator: str = "<SEP>") -> DataFrame:
    """Distinct values per key, sorted and joined."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def effective_permissions(user_roles: DataFrame, team_roles: DataFrame, members: DataFrame, role_permissions: DataFrame, at: Column) -> DataFrame:
    """(user_id, resource_id, permission, level): the highest level over direct roles and those of the user's teams.

    user_roles: user_id, role_id, resource_id, expires_at; team_roles: team_id, role_id, resource_id, expires_at; members: team_id, user_id;
    role_permissions: role_id, permission, level. A null resource is every resource; a null expiry never expires.
    """
    valid = F.col("expires_at").isNull() | (F.col("expires_at") > at)
    direct = user_roles.where(valid).select("user_id", "role_id", "resource_id")
    team = team_roles.where(valid).join(members, "team_id").select("user_id", "role_id", "resource_id")
    return direct.unionByName(team).join(small(role_permissions), "role_id").groupBy("user_id", "resource_id", "permission").agg(F.max("level").alias("level"))


def compare_permissions(granted: DataFrame, left: str, right: str) -> DataFrame:
    """Where two users differ: resource_id, permission and both levels (0: none)."""
    pick = lambda u, n: granted.where(F.col("user_id") == u).select(F.coalesce("resource_id", F.lit("*")).alias("resource_id"), "permission", F.col("level").alias(n))
    both = pick(left, "left_level").join(pick(right, "right_level"), ["resource_id", "permission"], "full")
    return both.fillna(0, ["left_level", "right_level"]).where("left_level <> right_level")


def unique_names(df: DataFrame, name: str, order: str, *within: str) -> DataFrame:
    """Repeated names get '(1)', '(2)' ... before their extension, in ``order``."""
    w = Window.partitionBy(*within, name).orderBy(order)
    stem, ext = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    rn = F.row_number().over(w) - 1
    return df.withColumn("_n", rn).withColumn(name, F.when(F.col("_n") > 0, F.concat(stem, F.lit("("), F.col("_n").cast("string"), F.lit(")"), ext)).otherwise(F.col(name))).drop("_n")


def merged_config(base: Column, override: Column) -> Column:
    """JSON objects merged at the top level; keys of the override win."""
    schema = "map<string,string>"
    a, b = F.from_json(F.coalesce(base, F.lit("{}")), schema), F.from_json(F.coalesce(override, F.lit("{}")), schema)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
