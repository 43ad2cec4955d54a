import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.mixing import allocate, choose, fill, reached, source_sizes, water
from docloom.llm.tokens import with_token_count

SIZED = "doc_id bigint, source string, n_tokens bigint, whole string, rest string"
TARGETS = "source string, target_share double, max_repeats int, own string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 1000), st.integers(1, 4)), min_size=1, max_size=6), st.floats(1, 5000))
def test_water_filling(rows, total):
    shares, caps = {str(i): w for i, (w, _, _) in enumerate(rows)}, {str(i): n * r for i, (_, n, r) in enumerate(rows)}
    got = fill(shares, caps, total)
    assert all(got[s] <= caps[s] + 1e-6 for s in got)
    assert sum(got.values()) == pytest.approx(min(total, sum(caps.values())), rel=1e-6)
    free = [s for s in got if got[s] < caps[s] - 1e-6]
    level = {round(got[s] / shares[s], 6) for s in free}
    assert len(level) <= 1 or max(level) - min(level) < 1e-3 * max(level)


def test_mix_respects_caps_and_reports(spark):
    rows = [(i, " A " if i % 2 else "a", 10, "x", "y") for i in range(300)] + [(1000 + i, "B", 7, "", "") for i in range(20)] + [(5000, None, 9, "", ""), (5001, " ", 9, "", ""), (5002, "c", None, "", "")]
    sized = spark.createDataFrame(rows, SIZED)
    targets = spark.createDataFrame([("a", 0.5, 2, ""), ("b", 0.4, 3, ""), ("c", 0.05, 2, ""), ("nobody", 0.05, 2, ""), (None, 0.5, 1, "")], TARGETS)
    plan = allocate(source_sizes(sized), targets)
    chosen = choose(sized, plan)
    by = {r.source: r for r in reached(plan, chosen).collect()}
    assert set(by) == {"a", "b", "c", "nobody"}
    assert by["b"].cannot_reach and by["b"].actual_tokens == 3 * 140 and by["b"].most_repeats == 3
    assert not by["a"].cannot_reach and by["a"].most_repeats <= 2 and abs(by["a"].actual_tokens - by["a"].allocated) < 10
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1)
    assert {r.doc_id for r in chosen.collect()}.isdisjoint({5000, 5001})
    again = {(r.doc_id, r.repeats) for r in choose(sized, plan).collect()}
    assert again == {(r.doc_id, r.repeats) for r in chosen.collect()}


def test_empty_and_token_counts(spark):
    none = spark.createDataFrame([], SIZED)
    targets = spark.createDataFrame([("a", 1.0, 2, "")], TARGETS)
    plan = allocate(source_sizes(none), targets)
    assert choose(none, plan).count() == 0 and plan.collect()[0].allocated == 0
    got = {r.k: r.n_tokens for r in with_token_count(spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "k int, text string"), "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_rounds_tell_own_targets_from_what_others_leave():
    given, rounds = water({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 35, "c": 500}, 100)
    assert rounds == {"a": 0, "b": 1} and given == {"a": 10, "b": 35, "c": 55}
