import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing as P


def brute(sizes, cap):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        rooms.append(cap - sizes[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 30).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.integers(1, cap), min_size=1, max_size=8), st.integers(0, 8))))
def test_exact_step_and_maps(case):
    cap, sizes, cut = case
    want = brute(sizes, cap)
    assert P.lower_bound(sizes, cap) <= want
    assert P.fits(sizes, cap, want) and (want == 1 or not P.fits(sizes, cap, want - 1))
    cut = min(cut, len(sizes))
    assert P.chain([P.next_fit_map(sizes[:cut], cap) if cut else [], P.next_fit_map(sizes[cut:], cap) if cut < len(sizes) else []]) == P.next_fit(sizes, cap)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.text("ab c", max_size=8)), min_size=1, max_size=30), st.integers(0, 20))
def test_packing_keeps_every_item_once_within_capacity(items, least):
    sizes, texts = [s for s, _ in items], [t for _, t in items]
    bins = P.pack_shard(sizes, texts, 50, least)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


def test_neighbours_come_before_strangers():
    texts = ["red valve opens", "blue sky", "red valve closes", "green tree"]
    assert P.pack_shard([5, 4, 4, 4], texts, 9)[0] == [0, 2]


SCHEMA = "collection string, item string, position int, size int, cap int, least int, text string, shard string"


def test_documents_hot_collection_and_dirt(spark):
    rnd = random.Random(3)
    rows = [("d", f"i{i}", i, rnd.randint(1, 60), 100, 0, "w" * (i % 5), "clash") for i in range(3 * P.SHARD)]
    rows += [("tie", f"t{i}", 1, 3, 10, 0, None, "") for i in range(4)] + [("e", "over", 1, 101, 100, 0, "", ""), (None, "n", 1, 1, 5, 0, "", ""), ("z", "zero", 1, 0, 5, 0, "", "")]
    items = spark.createDataFrame(rows, SCHEMA)
    got = {r.collection: r for r in P.collections(P.pack_shards(items)).collect()}
    assert set(got) == {"d", "tie"}
    assert got["d"].n_items == 3 * P.SHARD
    assert got["d"].n_reading == P.next_fit([r[3] for r in rows if r[0] == "d"], 100)
    assert got["d"].n_best <= got["d"].n_packed and got["d"].fewer
    assert (got["tie"].n_reading, got["tie"].n_best) == (2, 2)
    assert P.collections(P.pack_shards(spark.createDataFrame([], SCHEMA))).count() == 0


def test_worse_reading_order_is_found(spark):
    rows = [("a", f"i{i}", i, s, 10, 0, None, "") for i, s in enumerate([6, 5, 4, 5])]  # 6 | 5 4 | 5 against 6 4 | 5 5
    assert P.collections(P.pack_shards(spark.createDataFrame(rows, SCHEMA))).collect()[0].fewer


def emitted(spark, items):
    shards = P.pack_shards(items).cache()
    decided = P.collections(shards).cache()
    return {r.collection: r for r in decided.collect()}, P.containers(shards, items, decided).collect()


def test_emitted_containers_are_those_counted(spark):
    rnd = random.Random(5)
    rows = [(f"c{k}", f"{k}-{i}", i, rnd.choice([3, 4, 5, 6, 7, 9]), 12, 0, rnd.choice(["a b", "c", None]), "") for k in range(60) for i in range(rnd.randrange(2, 14))]
    rows += [("big", f"b{i}", i, s, 100, 0, "", "") for i, s in enumerate([30, 40, 40, 30, 30, 30] + [40, 30, 30] * 998)]
    items = spark.createDataFrame(rows, SCHEMA)
    decided, out = emitted(spark, items)
    assert sorted(r.item for r in out) == sorted(r[1] for r in rows)
    boxes: dict = {}
    for r in out:
        boxes.setdefault((r.collection, r.container), []).append(r.size)
        assert r.size == next(x[3] for x in rows if x[1] == r.item) if r.collection != "big" else True
    assert all(sum(b) <= decided[c].cap for (c, _), b in boxes.items())
    for c, d in decided.items():
        n = sum(1 for k, _ in boxes if k == c)
        assert n == d.n_best or (not d.fewer and n == d.n_packed)
        if c != "big":
            sizes = [r[3] for r in rows if r[0] == c]
            assert d.fewer == (brute(sizes, 12) < P.next_fit(sizes, 12)) and not d.undecided
    assert decided["big"].fewer


def test_shards_are_joined_in_tiers(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    monkeypatch.setattr(P, "SHARD", 16)
    rnd = random.Random(6)
    rows = [("a", f"a{i}", i * 700, rnd.randint(1, 30), 31, 0, None, "") for i in range(200)] + [("b", f"b{i}", 5, 3, 10, 0, None, "") for i in range(90)] + [("c", "c", None, 2, 5, 0, None, "")]
    got, _ = emitted(spark, spark.createDataFrame(rows, SCHEMA))
    assert got["a"].n_reading == P.next_fit([r[3] for r in rows if r[0] == "a"], 31) and got["a"].n_items == 200
    assert (got["b"].n_reading, got["b"].n_items, got["c"].n_reading) == (30, 90, 1)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 20).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.integers(1, cap), min_size=1, max_size=20), st.lists(st.integers(0, 20), min_size=2, max_size=2))))
def test_joined_maps(case):
    cap, sizes, cuts = case
    i, j = sorted(min(c, len(sizes)) for c in cuts)
    maps = [P.next_fit_map(x, cap) if x else [] for x in (sizes[:i], sizes[i:j], sizes[j:])]
    for joined in (P.joined_maps(P.joined_maps(maps[0], maps[1]), maps[2]), P.joined_maps(maps[0], P.joined_maps(maps[1], maps[2]))):
        assert P.chain([joined]) == P.next_fit(sizes, cap)
        assert P.chain([P.next_fit_map([1], cap), joined]) == P.next_fit([1, *sizes], cap)


def test_token_counts_are_those_of_the_tables(spark):
    import re

    from docloom.functions.text import PY_TOKEN
    from docloom.llm.tokens import with_run_count

    texts = ["", None, " a b", "水泵ab 一c", "x y　z w\x0bv\x1cq\x85r​s", "é\n\tü--\U0001f600 ok", " a b c d e"]
    got = with_run_count(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").collect()
    assert {r.i: r["size"] for r in got} == {i: len(re.findall(PY_TOKEN, t or "")) for i, t in enumerate(texts)}
