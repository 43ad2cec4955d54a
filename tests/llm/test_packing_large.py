import random
from collections import Counter

from docloom.llm import packing as P

SCHEMA = "collection string, item string, position int, size int, cap int, least int, text string"


def test_large_collections_are_decided_on_the_histogram(spark):
    sizes = [30, 40, 40, 30, 30, 30] + [40, 30, 30] * 998
    tight = [40, 60] * 1500
    rows = [("a", f"a{i}", i, s, 100, 0, "") for i, s in enumerate(sizes)] + [("b", f"b{i}", i, s, 100, 0, "") for i, s in enumerate(tight)]
    got = {r.collection: r for r in P.collections(P.pack_shards(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got["a"].n_reading, got["a"].n_best, got["a"].fewer, got["a"].undecided) == (1001, 1000, True, False)
    assert (got["b"].n_reading, got["b"].n_best, got["b"].fewer, got["b"].undecided) == (1500, 1500, False, False)


def test_histogram_bound_and_patterns():
    random.seed(3)
    for _ in range(300):
        cap = random.randrange(8, 60)
        sizes = [random.randrange(1, cap + 1) for _ in range(random.randrange(1, 30))]
        hist = Counter(sizes)
        assert P._least_bins(hist, cap) == P.lower_bound(sizes, cap)
        for boxes in (P._pattern_fill(hist, cap, 0), P._first_fit(hist, cap)):
            assert P.lower_bound(sizes, cap) <= sum(n for n, _ in boxes)
            assert all(sum(b) <= cap for _, b in boxes) and sum((Counter({s: n * b.count(s) for s in set(b)}) for n, b in boxes), Counter()) == hist
        one = P._pattern(sorted(hist.items(), reverse=True), cap)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums if x + s <= cap}
        assert sum(s * n for s, n in one.items()) == max(sums) and all(n <= hist[s] for s, n in one.items())
