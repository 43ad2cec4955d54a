"""Knowledge graphs as node and edge frames: parsing, merging, ranking, components, communities, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.lexical import char_bigrams, clean_name
from docloom.runtime import materialize, release, small

SEPARATOR = "<SEP>"
LATIN = "^[A-Za-z0-9 .,'_-]+$"


def parse_records(df: DataFrame, text: str, source: str, field: str = "<|>", record: str = "##") -> tuple[DataFrame, DataFrame]:
    """Delimited records to (entities, relations).

    ("entity"<|>name<|>type<|>description) needs four fields; ("relationship"<|>src<|>dst<|>description[<|>keywords]<|>weight) five. Names
    are cleaned; a relation's ends are ordered; a weight that is no number counts 1. Malformed records are dropped.
    """
    recs = df.select(F.col(source).alias("source_id"), F.explode(F.split(text, record)).alias("r"))
    body = F.regexp_extract("r", r"(?s)\((.*)\)", 1)
    f = recs.select("source_id", F.transform(F.split(body, r"<\|>"), lambda x: F.trim(x)).alias("f"))
    kind = F.lower(F.regexp_replace(F.get("f", F.lit(0)), '"', ""))
    ent = f.where((kind == "entity") & (F.size("f") >= 4)).select("source_id", clean_name(F.get("f", F.lit(1))).alias("name"), clean_name(F.get("f", F.lit(2))).alias("type"), F.get("f", F.lit(3)).alias("description")).where("name <> ''")
    a, b = clean_name(F.get("f", F.lit(1))), clean_name(F.get("f", F.lit(2)))
    rel = f.where((kind == "relationship") & (F.size("f") >= 5)).select("source_id", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.get("f", F.lit(3)).alias("description"), F.coalesce(F.element_at("f", -1).try_cast("double"), F.lit(1.0)).alias("weight"))
    return ent, rel.where("src <> '' and dst <> ''")


def merge_nodes(entities: DataFrame) -> DataFrame:
    """(name, type, description, source_id): most frequent type, distinct descriptions and sources sorted."""
    types = entities.groupBy("name", "type").agg(F.count("*").alias("_n")).groupBy("name").agg(F.min(F.struct((-F.col("_n")).alias("o"), "type")).alias("_t"))
    rest = entities.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("description")), SEPARATOR).alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_id"))
    return rest.join(types, "name").select("name", F.col("_t.type").alias("type"), "description", "source_id")


def merge_edges(relations: DataFrame) -> DataFrame:
    """(src, dst, weight, description, source_id), src < dst: weights summed, the rest united. Self loops are dropped."""
    return relations.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("description")), SEPARATOR).alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_id"))


def shared_pairs(rows: DataFrame, group: str, item: str, block: int = 512) -> DataFrame:
    """(src, dst, weight): any two items of one group, by groups shared, src < dst. Null groups and items take no part.

    A group of more than ``block`` items is dealt into blocks; each pair of blocks meets under a key of its own, so that no
    group has to be paired by one task.
    """
    one = rows.select(F.col(group).alias("_g"), F.col(item).alias("_i")).where("_g is not null and _i is not null").distinct()
    large = materialize(one.groupBy("_g").agg(F.count("*").alias("_c")).where(F.col("_c") > block).select("_g", F.ceil(F.col("_c") / block).cast("int").alias("_k")))
    dealt = one.join(small(large), "_g", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_k")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    a = dealt.select("_g", F.col("_b").alias("_x"), all_blocks.alias("_y"), F.col("_i").alias("src"))
    b = dealt.select("_g", all_blocks.alias("_x"), F.col("_b").alias("_y"), F.col("_i").alias("dst"))
    return a.join(b, ["_g", "_x", "_y"]).where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """Edges both of whose ends exist."""
    n = nodes.select(F.col(key).alias("_k"))
    return edges.join(n, F.col("src") == F.col("_k"), "left_semi").join(n, F.col("dst") == F.col("_k"), "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank) of a weighted undirected graph after ``rounds`` steps; ranks sum to 1. Isolated nodes are not in edges.

    Edges are partitioned by source once; lineage is cut every ``cut_every`` rounds.
    """
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.sum("weight").alias("_o"))
    p = materialize(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_o")).alias("p")).repartition("src"))
    nodes = materialize(p.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    last = None
    for i in range(rounds):
        got = p.join(rank, p.src == rank.node).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("_s"))
        rank = got.select(F.col("dst").alias("node"), ((1 - damping) / max(1, n) + damping * F.col("_s")).alias("rank"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rank = materialize(rank)
            if last is not None:
                release(last)
            last = rank
    return rank


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components named by their smallest node.

    Labels go to the smallest neighbour's label, then jump to that label's own: rounds grow with the logarithm of the diameter.
    """
    e = materialize(both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst").distinct())
    label = materialize(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m")).select("node", F.least("node", "_m").alias("component")))
    while True:
        near = e.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_n"))
        stepped = label.join(near, "node").select("node", F.least("component", "_n").alias("component"), F.col("component").alias("_old"))
        jump = stepped.select(F.col("node").alias("component"), F.col("component").alias("_j"))
        step = materialize(stepped.join(jump, "component").select("node", F.least("component", "_j").alias("component"), "_old"))
        moved = not step.where("component <> _old").isEmpty()
        release(label)
        path = step._docloom_path
        label = step.drop("_old")
        label._docloom_path = path
        if not moved:
            return label


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component; of equals the one with the smallest name."""
    comp = components(edges)
    best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    inside = comp.join(F.broadcast(best), "component", "left_semi")
    return edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi")


def communities(edges: DataFrame, rounds: int = 8, cap: int = 12) -> DataFrame:
    """(node, level0, level1): weighted label propagation, then again inside communities above ``cap`` nodes.

    Synchronous rounds with a fixed tie rule and a pull towards the own label, so that the result is deterministic and does not
    flip between two states. Stands in for hierarchical Leiden, which is sequential.
    """

    def propagate(e: DataFrame) -> DataFrame:
        label = materialize(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
        for _ in range(rounds):
            votes = e.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
            own = label.select("node", "label", F.lit(0.5).alias("w"))
            best = votes.unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w")).groupBy("node").agg(F.min(F.struct((-F.round("w", 6)).alias("o"), "label")).alias("b"))
            nxt = materialize(best.select("node", F.col("b.label").alias("label")))
            release(label)
            label = nxt
        return label

    e = materialize(both_ways(edges))
    first = propagate(e)
    size = first.groupBy("label").agg(F.count("*").alias("n"))
    big = first.join(size.where(F.col("n") > cap), "label").select("node", "label")
    inner = e.join(big.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src").join(big.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst").where("_a = _b")
    # inside big communities only their stronger half of edges counts
    mean = inner.groupBy("_a").agg(F.avg("weight").alias("_m"))
    second = propagate(inner.join(small(mean), "_a").where(F.col("weight") >= F.col("_m")).select("src", "dst", "weight"))
    return first.join(second.select("node", F.col("label").alias("_l")), "node", "left").select("node", F.col("label").alias("level0"), F.coalesce("_l", "label").alias("level1"))


def community_weights(members: DataFrame, ranks: DataFrame, level: str = "level0") -> DataFrame:
    """(community, weight, size): ranks summed, over the largest sum; communities of one node are left out."""
    w = members.join(ranks, "node").groupBy(F.col(level).alias("community")).agg(F.sum("rank").alias("_w"), F.count("*").alias("size")).where("size >= 2")
    top = w.agg(F.max("_w").alias("_m"))
    return w.crossJoin(F.broadcast(top)).select("community", (F.col("_w") / F.col("_m")).alias("weight"), "size")


def similar_names(a: Column, b: Column) -> Column:
    """Whether two names may mean one entity: no digit among the two-character pieces that differ, and a small edit distance."""
    x, y = char_bigrams(a), char_bigrams(b)
    differing = F.concat(F.array_except(x, y), F.array_except(y, x))
    digits = F.exists(differing, lambda p: p.rlike("[0-9]"))
    latin = a.rlike(LATIN) & b.rlike(LATIN)
    close = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 2)
    ca, cb = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    most = F.greatest(F.size(ca), F.size(cb))
    both = F.size(F.array_intersect(ca, cb))
    return ~digits & F.when(latin, close).when(most < 4, both > 1).otherwise(both >= 0.8 * most)


def resolution_pairs(nodes: DataFrame, block: int = 512) -> DataFrame:
    """(a, b): all pairs of one type whose names are similar, a < b.

    Complete for ``similar_names``. Within floor(shorter / 2) edits two Latin names have at least half of each one's characters in common,
    counted with repeats, so the rarer half of them and one more must meet; other pairs share 80 % of their distinct characters, or
    two of up to three. Keys of many names are paired in blocks.
    """
    names = nodes.select("name", "type").where("name is not null and type is not null").distinct()
    chars = names.withColumn("latin", F.col("name").rlike(LATIN)).withColumn("c", F.filter(F.split("name", ""), lambda x: x != ""))
    counted = chars.select("name", "type", "latin", F.explode("c").alias("c")).groupBy("name", "type", "latin", "c").agg(F.count("*").cast("int").alias("n"))
    latin = counted.where("latin").select("name", "type", F.lit("L").alias("kind"), "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("no"))
    keys = latin.unionByName(counted.select("name", "type", F.lit("C").alias("kind"), "c", F.lit(1).alias("no")))
    df = keys.groupBy("type", "kind", "c", "no").agg(F.count("*").alias("_n"))
    per = keys.join(df, ["type", "kind", "c", "no"]).groupBy("name", "type", "kind").agg(F.array_sort(F.collect_list(F.struct("_n", "c", "no"))).alias("k"))
    n = F.size("k")
    shared = F.when(F.col("kind") == "L", F.ceil(n / 2)).when(n < 4, F.lit(2)).otherwise(F.ceil(n * 4 / 5)).cast("int")
    rare = per.where(n >= shared).select("name", "type", "kind", F.explode(F.slice("k", F.lit(1), n - shared + 1)).alias("k"))
    keyed = rare.select("name", F.struct("type", "kind", "k.c", "k.no").alias("g"))
    return shared_pairs(keyed, "g", "name", block).select(F.col("src").alias("a"), F.col("dst").alias("b")).where(similar_names(F.col("a"), F.col("b")))


def merge_resolved(nodes: DataFrame, edges: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge nodes that were judged the same (columns a, b) into the smallest of their component, and move their edges."""
    comp = components(same.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    to = comp.select(F.col("node").alias("_k"), "component")
    n = nodes.join(to, nodes.name == F.col("_k"), "left").withColumn("name", F.coalesce("component", "name")).drop("_k", "component")
    e = edges.join(to, F.col("src") == F.col("_k"), "left").withColumn("src", F.coalesce("component", "src")).drop("_k", "component")
    e = e.join(to, F.col("dst") == F.col("_k"), "left").withColumn("dst", F.coalesce("component", "dst")).drop("_k", "component")
    return n, e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}).where("src <> dst")


def top_view(nodes: DataFrame, edges: DataFrame, most_nodes: int = 256, most_edges: int = 128, node: str = "node", by: str = "rank") -> DataFrame:
    """Heaviest edges among the highest-ranked nodes, without self loops."""
    best = nodes.orderBy(F.col(by).desc(), node).limit(most_nodes).select(F.col(node).alias("name"))
    return with_endpoints(edges.where("src <> dst"), best).orderBy(F.col("weight").desc(), "src", "dst").limit(most_edges)


def path_scores(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, score): similarity of an entity spread along its paths, divided by 2 + position.

    entities: name, similarity. paths: name, path (array of nodes from the entity on).
    """
    n = F.size("path")
    hops = paths.join(entities, "name").where(n > 1).select("similarity", F.posexplode(F.zip_with(F.slice("path", 1, n - 1), F.slice("path", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "h"))
    return hops.select(F.least("h.a", "h.b").alias("src"), F.greatest("h.a", "h.b").alias("dst"), (F.col("similarity") / (2 + F.col("i"))).alias("s")).groupBy("src", "dst").agg(F.sum("s").alias("score"))


def paths_from(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(name, path): paths of exactly 1..hops edges from each start; no node twice. One join per hop."""
    step = both_ways(edges).select(F.col("src").alias("_t"), F.col("dst").alias("_n"))
    at = starts.select("name", F.array("name").alias("path"))
    out = None
    for _ in range(hops):
        at = at.join(step, F.element_at("path", -1) == F.col("_t")).where(~F.array_contains("path", F.col("_n"))).select("name", F.array_append("path", F.col("_n")).alias("path"))
        out = at if out is None else out.unionByName(at)
    return out


def two_hop_scores(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, score): what ``path_scores`` gives over ``paths_from`` with two hops, without listing the paths.

    The edge x-y opens one path of x, and one more per other neighbour of y; it ends those that come to x from neighbours other than y.
    ``edges`` are distinct and without self loops.
    """
    near = both_ways(edges).join(entities.select(F.col("name").alias("src"), F.col("similarity").alias("_m")), "src", "left")
    near = near.groupBy(F.col("dst").alias("_v")).agg(F.count("*").alias("_d"), F.count("_m").alias("_c"), F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_s"))
    near = near.join(entities.select(F.col("name").alias("_v"), F.col("similarity").alias("_m")), "_v", "left")
    near = materialize(near.select("_v", "_d", (F.col("_m").isNotNull() | (F.col("_c") > 0)).alias("_c"), "_s", F.coalesce("_m", F.lit(0.0)).alias("_m")))
    side = lambda key, name: near.select(F.col("_v").alias(key), F.struct("_d", "_c", "_s", "_m").alias(name))
    j = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a._c or b._c")
    return j.select("src", "dst", F.expr("(a._m * b._d + b._m * a._d) / 2 + (a._s - b._m + b._s - a._m) / 3").alias("score"))


def random_walks(edges: DataFrame, length: int = 4, seed: int = 3) -> DataFrame:
    """(node, walk): one weighted walk per node; each step takes the neighbour of the largest weighted hash."""
    e = both_ways(edges)
    at = e.select(F.col("src").alias("node")).distinct().withColumn("walk", F.array("node"))
    for i in range(length):
        u = (F.pmod(F.xxhash64(F.lit(seed + i), "node", "dst"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
        pick = at.join(e, F.element_at("walk", -1) == F.col("src")).groupBy("node", "walk").agg(F.max_by("dst", F.pow(u, 1 / F.col("weight"))).alias("_d"))
        at = pick.select("node", F.array_append("walk", F.col("_d")).alias("walk"))
    return at


def unique_labels(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Repeated labels get a number behind them, from the second on."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("_n", n).withColumn("label", F.when(F.col("_n") > 1, F.concat(F.col(label), F.lit("("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col(label))).drop("_n")


def cluster_tree(rows: DataFrame, summarise, key: str = "vec_id", vector: str = "embedding", most: int = 10, dims: int = 8, seed: int = 5, sample: int = 20_000) -> DataFrame:
    """(layer, node, parent, n_members, vector): layers of Gaussian mixtures until one node is left.

    The number of clusters is chosen by the Bayesian information criterion on at most ``sample`` vectors (a documented bound on
    model fitting); every vector is assigned. ``summarise`` maps the mean vector of a cluster to its text or vector; it is injected.
    """
    import numpy as np
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    at = rows.select(F.col(key).cast("string").alias("node"), F.col(vector).cast("array<double>").alias("vector"), F.lit(1).cast("bigint").alias("n_members"))
    out, layer = None, 0
    while True:
        at = materialize(at)
        n = at.count()
        if n <= 1:
            top = at.select(F.lit(layer).alias("layer"), "node", F.lit(None).cast("string").alias("parent"), "n_members", "vector")
            return top if out is None else out.unionByName(top)
        k_most = max(1, min(most, n // 3))
        feats = at.withColumn("_v", array_to_vector("vector"))
        if k_most > 1:
            width = len(at.first().vector)
            # a hash sample, the same in every run, of about ``sample`` vectors
            some = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
            model = PCA(k=min(dims, width), inputCol="_v", outputCol="_p").fit(feats.where(some))
            space = materialize(model.transform(feats).select("node", vector_to_array("_p").alias("_pa"))).withColumn("_p", array_to_vector("_pa"))
            fit = space.where(some)
            best = None
            d = min(dims, width)
            for k in range(2, k_most + 1, max(1, k_most // 4)):
                gm = GaussianMixture(k=k, featuresCol="_p", predictionCol="_c", probabilityCol="_q", seed=seed, maxIter=20).fit(fit)
                bic = -2 * gm.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * np.log(min(n, sample))
                if best is None or bic < best[0]:
                    best = (bic, gm)
            labelled = best[1].transform(space).select("node", F.col("_c").alias("_c"))
        else:
            labelled = at.select("node", F.lit(0).alias("_c"))
        placed = materialize(at.join(labelled, "node").withColumn("parent", F.concat(F.lit(f"L{layer + 1}-"), F.col("_c").cast("string"))))
        done = placed.select(F.lit(layer).alias("layer"), "node", "parent", "n_members", "vector")
        out = done if out is None else out.unionByName(done)
        mean = placed.select("parent", "n_members", F.posexplode("vector").alias("i", "x")).groupBy("parent", "i").agg(F.avg("x").alias("m")).groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
        size = placed.groupBy("parent").agg(F.sum("n_members").alias("n_members"))
        at = mean.join(size, "parent").select(F.col("parent").alias("node"), summarise(F.col("vector")).alias("vector"), "n_members")
        layer += 1


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, json): a node-link record per node with its edges, the serialised form of a graph."""
    e = edges.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("links"))
    return nodes.join(e, "name", "left").select("name", F.to_json(F.struct("name", "type", "description", "links")).alias("json"))


def rebuilt(nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all subgraphs put together, without what only the ``excluded`` sources (source_id) brought."""
    kept = lambda df: df.join(excluded.select("source_id").distinct(), "source_id", "left_anti")
    return merge_nodes(kept(nodes)), merge_edges(kept(edges))


def entities_by_type(nodes: DataFrame, most: int, tie: str = "name") -> DataFrame:
    """The ``most`` entities of each type by falling rank, with their place."""
    w = Window.partitionBy("type").orderBy(F.col("rank").desc(), F.col(tie).asc())
    return nodes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def relations_of(edges: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Edges with an end among ``names``; ``both_ends`` tells whether the other end is there too."""
    n = names.select(F.col(key).alias("_k")).distinct()
    a = edges.join(n.select(F.col("_k").alias("src"), F.lit(True).alias("_a")), "src", "left").join(n.select(F.col("_k").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    return a.where("_a or _b").withColumn("both_ends", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")


def community_reports(members: DataFrame, edges: DataFrame, ranks: DataFrame, report, level: str = "level0", most_edges: int = 10_000) -> DataFrame:
    """(community, size, n_edges, report) of communities of two and more nodes.

    ``report`` (injected, a model) maps the entities ('name,rank' a line, by falling rank) and relations ('src,dst,weight' a line, by falling
    weight, at most ``most_edges``, the bound of a prompt) to a text. ``n_edges`` counts all relations inside.
    """
    own = members.select("node", F.col(level).alias("community"))
    line = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") for x in c])
    listed = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")
    entities = own.join(ranks, "node").groupBy("community").agg(F.count("*").alias("size"), listed(F.struct(-F.col("rank"), "node"), line("node", "rank")).alias("_e")).where("size >= 2")
    inner = edges.join(own.select(F.col("node").alias("src"), "community"), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("_c")), "dst").where(F.col("community") == F.col("_c"))
    first = inner.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.col("weight").desc(), "src", "dst"))).where(F.col("_r") <= most_edges)
    relations = first.groupBy("community").agg(listed(F.col("_r"), line("src", "dst", "weight")).alias("_t"))
    counts = inner.groupBy("community").agg(F.count("*").alias("n_edges"))
    rows = entities.join(relations, "community", "left").join(counts, "community", "left")
    return rows.select("community", "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), report(F.col("_e"), F.coalesce("_t", F.lit(""))).alias("report"))
