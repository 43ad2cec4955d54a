import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.hierarchy import current_links, descendants, euler_tour, hierarchy, ring_members
from docloom import runtime
from docloom.runtime import materialize

SCHEMA = "file_id string, parent_id string, file_name string, update_time timestamp, node string, ring string"


def links_of(spark, rows):
    df = spark.createDataFrame([(a, b, n, None, "clash", "clash") for a, b, n in rows], SCHEMA)
    return materialize(current_links(df, "file_id", "parent_id", F.col("update_time"), ["file_name"]))


def brute(rows):
    first = {}
    for a, b, n in rows:
        if a is not None:
            first[a] = (b, n)
    parent = {a: (b.strip() if b and b.strip() in first and b.strip() != a else None) for a, (b, _) in first.items()}
    out = {}
    for a in parent:
        seen, at = [a], parent[a]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[a] = (seen[-1], len(seen) - 1, "/".join(first[x][1] or "" for x in reversed(seen)), None)
        else:
            out[a] = (None, -1, None, min(seen[seen.index(at) :]))
    return parent, out


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_random_forests_with_rings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        kind = rnd.random()
        p = f"n{rnd.randrange(120)}" if kind < 0.85 else rnd.choice([None, "", f"n{i}", "gone"])
        rows.append((f"n{i}", p, rnd.choice(["x", "y", None])))
    rows += [(f"chain{i}", f"chain{i - 1}" if i else None, str(i)) for i in range(70)] + [(f"kid{i}", "chain9", "k") for i in range(60)]
    links = links_of(spark, rows)
    parent, want = brute(rows)
    got = {r.node: (r.root, r.depth, r.path, r.ring) for r in hierarchy(links, "file_name").collect()}
    assert got == want
    assert {r.node: r.ring for r in ring_members(links).collect()} == {a: w[3] for a, w in want.items() if w[3]}
    pairs = {(r.ancestor, r.descendant) for r in descendants(materialize(euler_tour(links))).collect()}
    expect = set()
    for a, w in want.items():
        at = parent[a]
        while w[3] is None and at is not None:
            expect.add((at, a))
            at = parent[at]
    assert pairs == expect


def test_empty_repeated_and_null_rows(spark):
    assert hierarchy(links_of(spark, []), "file_name").count() == 0
    links = links_of(spark, [("a", None, "A"), ("a", None, "A"), (None, "a", "x"), ("b", "a", None)])
    assert {(r.node, r.path, r.n_descendants) for r in hierarchy(links, "file_name").collect()} == {("a", "A", 1), ("b", "A/", 0)}


def test_ring_only(spark):
    links = links_of(spark, [("a", "b", ""), ("b", "c", ""), ("c", "a", ""), ("d", "a", ""), ("s", "s", "")])
    assert {(r.node, r.ring) for r in ring_members(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a")}


def test_siblings_keep_a_given_order(spark):
    links = links_of(spark, [("r", None, "0"), ("a", "r", "3"), ("b", "r", "1"), ("c", "r", "2")])
    assert [r.node for r in euler_tour(links, "file_name").orderBy("entry").collect()] == ["r", "b", "c", "a"]
