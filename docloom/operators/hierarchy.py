"""Parent-child links to full hierarchies, by parallel tree techniques.

1. Peeling: doubling the parent function f gives f^(2^k); the image of f^m is what remains after m
   rounds of removing leaves. When the image stops shrinking only rings (and roots) are left.
2. Euler tours: every node of the remaining forest contributes a down and an up arc; list ranking by
   pointer doubling turns the successor lists into positions, in log2(tour) rounds.
3. The entry-exit interval of a node gives depth, root, ancestors, path and all descendants.

Rounds grow with the logarithm of the depth or size, never with the depth itself, and every round is an
equi-join on node ids: no group of nodes is gathered anywhere, whichever tenant or tree is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import runtime
from docloom.runtime import latest, materialize, release, skewed_join

#: Consecutive tour positions that the interval join keeps together.
TOUR_BLOCK = 256
#: Buckets of a node's children, by hash: children are ordered bucket by bucket.
BUCKETS = 1024


def current_links(rows: DataFrame, node: str, parent: str, version: Column, extra: list[str]) -> DataFrame:
    """(node, parent, extra...): the current version of each node; parent null for roots.

    A root has its own id, null or blank as parent. Rows without a node id are dropped: they cannot be
    named. A parent that does not exist makes the node the root of its own tree, flagged ``dangling``.
    """
    chosen = list(dict.fromkeys([node, parent, *extra]))
    one = latest(rows.where(F.col(node).isNotNull()).select(*chosen, version.alias("_version")), [node], [F.col("_version")])
    up = F.nullif(F.trim(parent), F.lit(""))
    links = one.select(F.col(node).alias("node"), F.when(up != F.col(node), up).alias("_up"), *[F.col(c) for c in extra])
    known = links.select(F.col("node").alias("_known"))
    return links.join(known, F.col("_up") == F.col("_known"), "left").select(
        "node", F.col("_known").alias("parent"), (F.col("_up").isNotNull() & F.col("_known").isNull()).alias("dangling"), *extra
    )


def peel(links: DataFrame) -> DataFrame:
    """(node, ring): the ring a node lies on or runs into, named by its smallest node; null for forest nodes.

    Doubles ``jump`` = f^(2^k) until its image keeps its size: f is then one-to-one on the image, which
    therefore holds rings only (chains that end in a root jump to null and drop out).
    """
    state = materialize(links.select("node", F.col("parent").alias("jump")).where("jump is not null"))
    size = -1
    while True:
        meeting = state.groupBy("jump").agg(F.count("*").alias("_n"))
        image, most = meeting.agg(F.count("*"), F.max("_n")).first()
        if image == size or image == 0:
            break
        size = image
        hop = state.select(F.col("node").alias("jump"), F.col("jump").alias("_next"))
        # doubling makes the last nodes of large trees the aim of all others
        near = skewed_join(state, hop, "jump", "node", materialize(meeting.where(F.col("_n") > runtime.HOT_ROWS))) if most > runtime.HOT_ROWS else state.join(hop, "jump")
        doubled = materialize(near.select("node", F.col("_next").alias("jump")))
        release(state)
        state = doubled
    if image == 0:
        release(state)
        return links.select("node", F.lit(None).cast("string").alias("ring"))
    rings = state.select(F.col("jump").alias("node")).distinct()
    on_ring = links.join(rings, "node", "left_semi").select("node", F.col("parent").alias("jump"), F.least("node", "parent").alias("low"))
    on_ring = materialize(on_ring)
    while True:  # doubling of the minimum: settled once every node knows its ring's smallest
        hop = on_ring.select(F.col("node").alias("jump"), F.col("jump").alias("_next"), F.col("low").alias("_low"))
        step = materialize(on_ring.join(hop, "jump").select("node", F.col("_next").alias("jump"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_moved")))
        release(on_ring)
        moved = not step.where("_moved").isEmpty()
        on_ring = step
        if not moved:
            break
    entry = state.join(on_ring.select(F.col("node").alias("jump"), F.col("low").alias("ring")), "jump").select("node", "ring")
    found = entry.unionByName(on_ring.select("node", F.col("low").alias("ring"))).groupBy("node").agg(F.min("ring").alias("ring"))
    return links.select("node").join(found, "node", "left")


def ring_members(links: DataFrame) -> DataFrame:
    """(node, ring) of the nodes on a ring of parents or whose chain of parents runs into one."""
    return peel(links).where("ring is not null")


def euler_tour(links: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes off any ring with ``root, depth, entry, exit`` (root: depth 0; positions from 0 per tree). Siblings follow each other by the column
    ``order``; without one by hash, so that those of a folder above a third of all files are lined up by many tasks.

    Arc ids are (node, 0) on the way down and (node, 1) on the way up. Each arc starts with its successor,
    distance 1 and weight +1 or -1; doubling adds what lies ahead until every pointer is at its end.
    """
    return _tour(links, materialize(peel(links)), order)


def _siblings(forest: DataFrame, order: str | None) -> DataFrame:
    """(node, parent, _next, _first): the sibling that follows, and whether a node is its parent's first child."""
    kids = forest.where("parent is not null")
    if order is not None:
        w = Window.partitionBy("parent").orderBy("_order", "node")
        return kids.select("node", "parent", F.lead("node").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"))
    kids = kids.withColumn("_b", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)))
    most = kids.groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= runtime.HOT_ROWS:
        w = Window.partitionBy("parent").orderBy("_b", "node")
        return kids.select("node", "parent", F.lead("node").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"))
    ends = kids.groupBy("parent", "_b").agg(F.min("node").alias("_low"))
    w = Window.partitionBy("parent").orderBy("_b")
    ends = ends.select("parent", "_b", F.lead("_low").over(w).alias("_ahead"), (F.row_number().over(w) == 1).alias("_head"))
    inside = Window.partitionBy("parent", "_b").orderBy("node")
    lined = kids.withColumn("_n", F.lead("node").over(inside)).withColumn("_r", F.row_number().over(inside)).join(ends, ["parent", "_b"])
    return lined.select("node", "parent", F.coalesce("_n", "_ahead").alias("_next"), (F.col("_head") & (F.col("_r") == 1)).alias("_first"))


def _tour(links: DataFrame, rings: DataFrame, order: str | None) -> DataFrame:
    forest = materialize(links.join(rings.where("ring is null"), "node", "left_semi").select("node", "parent", F.col(order if order else "node").alias("_order")))
    kids = materialize(_siblings(forest, order))
    first = kids.where("_first").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    nodes = forest.join(first, "node", "left").join(kids.select("node", "_next"), "node", "left")
    arc = lambda node, up: F.struct(node.alias("n"), F.lit(up).alias("u"))
    arcs = nodes.select(
        F.inline(
            F.array(
                F.struct(F.col("node").alias("n"), F.lit(0).alias("u"), F.coalesce(F.when(F.col("child").isNotNull(), arc(F.col("child"), 0)), arc(F.col("node"), 1)).alias("nx"), F.lit(1).alias("w")),
                F.struct(F.col("node").alias("n"), F.lit(1).alias("u"), F.coalesce(F.when(F.col("_next").isNotNull(), arc(F.col("_next"), 0)), F.when(F.col("parent").isNotNull(), arc(F.col("parent"), 1))).alias("nx"), F.lit(-1).alias("w")),
            )
        )
    ).select("n", "u", F.col("nx.n").alias("pn"), F.col("nx.u").alias("pu"), F.lit(1).cast("bigint").alias("ahead"), F.col("w").cast("bigint").alias("sum"), F.col("n").alias("last"))
    state = materialize(arcs)
    while not state.where("pn is not null").isEmpty():
        done, live = state.where("pn is null"), state.where("pn is not null")
        target = state.select(F.col("n").alias("pn"), F.col("u").alias("pu"), F.col("pn").alias("_pn"), F.col("pu").alias("_pu"), F.col("ahead").alias("_a"), F.col("sum").alias("_s"), F.col("last").alias("_l"))
        stepped = live.join(target, ["pn", "pu"]).select("n", "u", F.col("_pn").alias("pn"), F.col("_pu").alias("pu"), (F.col("ahead") + F.col("_a")).alias("ahead"), (F.col("sum") + F.col("_s")).alias("sum"), F.col("_l").alias("last"))
        after = materialize(stepped.unionByName(done))
        release(state)
        state = after
    down = state.where("u = 0").select(F.col("n").alias("node"), F.col("last").alias("root"), F.col("ahead").alias("_down"), (-F.col("sum")).alias("depth"))
    up = state.where("u = 1").select(F.col("n").alias("node"), F.col("ahead").alias("_up"))
    length = down.where("node = root").select("root", F.col("_down").alias("_n"))
    return (
        down.join(up, "node")
        .join(length, "root")
        .select("node", "root", F.col("depth").cast("int").alias("depth"), (F.col("_n") - F.col("_down")).alias("entry"), (F.col("_n") - F.col("_up")).alias("exit"))
    )


def descendants(tour: DataFrame) -> DataFrame:
    """(ancestor, descendant, ancestor_depth): every proper pair, by an interval join on tour positions.

    An interval is replicated to the blocks of ``TOUR_BLOCK`` positions it covers and meets only the entries
    of that block, so even a root above a third of all nodes is spread over as many joins as it has blocks.
    """
    block = lambda c: F.floor(c / TOUR_BLOCK)
    above = tour.where(F.col("exit") > F.col("entry") + 1).select("root", F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), F.col("entry").alias("_from"), F.col("exit").alias("_to"), F.explode(F.sequence(block(F.col("entry")), block(F.col("exit")))).alias("_b"))
    below = tour.select("root", F.col("node").alias("descendant"), "entry", block(F.col("entry")).alias("_b"))
    return above.join(below, ["root", "_b"]).where((F.col("entry") > F.col("_from")) & (F.col("entry") < F.col("_to"))).select("ancestor", "descendant", "ancestor_depth")


def hierarchy(links: DataFrame, name: str = "name", separator: str = "/") -> DataFrame:
    """node, root, depth, path, entry, exit, n_descendants, ring: one row per node.

    Nodes on or below a ring have ``ring``, depth and n_descendants -1, and no root, path or interval.
    Null names appear as empty path parts.
    """
    rings = materialize(peel(links))
    tour = materialize(_tour(links, rings, None))
    names = links.select(F.col("node").alias("ancestor"), F.coalesce(F.col(name), F.lit("")).alias("_name"))
    parts = (
        descendants(tour)
        .join(names, "ancestor")
        .select(F.col("descendant").alias("node"), F.col("ancestor_depth").alias("_d"), "_name")
        .unionByName(tour.join(names.withColumnRenamed("ancestor", "node"), "node").select("node", F.col("depth").alias("_d"), "_name"))
    )
    path = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_d", "_name"))).alias("_p")).select("node", F.array_join(F.transform("_p", lambda x: x["_name"]), separator).alias("path"))
    placed = tour.join(path, "node").select("node", "root", "depth", "path", "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint").alias("n_descendants"))
    ringed = rings.where("ring is not null")
    return placed.join(ringed, "node", "full").withColumns({"depth": F.coalesce("depth", F.lit(-1)), "n_descendants": F.coalesce("n_descendants", F.lit(-1).cast("bigint"))})
