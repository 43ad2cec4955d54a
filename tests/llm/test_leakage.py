import random
import re

from docloom.llm.leakage import consistent, leaks, reparameterised, strip, vocabulary

ITEMS = "item_id bigint, text string, h string, before string"
DOCS = "doc_id bigint, text string, h string, key string"


def brute(items, docs, run=100):
    out = set()
    for i, t in items:
        a = strip(t)
        pieces = {a[p : p + run] for p in range(len(a) - run + 1)}
        for d, u in docs:
            b = strip(u)
            if any(b[p : p + run] in pieces for p in range(len(b) - run + 1)):
                out.add((i, d))
    return out


def test_runs_at_the_limit_with_numbers_names_and_noise(spark):
    rnd = random.Random(9)
    words = ["pump", "valve", "Crafol 12", "opens", "at", "37 bar", "der", "Zustand", "水泵", "77,123", "Mk 4", "x"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, make(40)) for i in range(30)]
    docs = []
    for d in range(160):
        i, t = rnd.choice(items)
        s = strip(t)
        n = rnd.choice([98, 99, 100, 101, 130])
        a = rnd.randrange(max(1, len(s) - n))
        part = s[a : a + n].upper() if d % 2 else " . ".join(re.findall(".{1,9}", s[a : a + n]))
        docs.append((d, make(rnd.randrange(30)) + part + make(rnd.randrange(30))))
    docs += [(900, None), (901, ""), (902, "short"), (903, items[0][1]), (903, items[0][1]), (904, "7" * 300)]
    items += [(90, None), (91, ""), (92, items[0][1]), (93, "7" * 150)]
    got = leaks(spark.createDataFrame([(*r, "", "") for r in items], ITEMS), spark.createDataFrame([(*r, "", "") for r in docs], DOCS))
    rows = [(r.item_id, r.doc_id) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute([x for x in items if x[1]], [x for x in docs if x[1]])


def test_reparameterised_questions_keep_slots_consistent(spark):
    q = "The pump of {n} {a} must stay below {b} bar until the {n} {a} valve of the second line opens at {c} bar again today"
    items = [(1, q.format(n="Crafol", a=12, b=40, c=55)), (2, None)]
    docs = [(1, q.format(n="Crafol", a=77, b=41, c=56)), (2, q.format(n="Crafol", a=12, b=40, c=55)), (3, q.format(n="Crafol", a=77, b=41, c=56).replace("77 valve", "78 valve")), (4, "other text " * 20), (5, None)]
    got = {r.doc_id: r for r in reparameterised(spark.createDataFrame([(*r, "", "") for r in items], ITEMS), spark.createDataFrame([(*r, "", "") for r in docs], DOCS)).collect()}
    assert 1 in got and got[1].n_changed >= 2
    assert 2 not in got and 4 not in got
    assert 3 not in got or got[3].n_windows < got[1].n_windows


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert leaks(none, spark.createDataFrame([(1, "x" * 200, "", "")], DOCS)).count() == 0


def test_planted_questions_with_other_values_are_found(spark):
    """Of 120 questions asked with other values, at least nine in ten are found; neither strangers nor unchanged copies are."""
    rnd = random.Random(12)
    verbs, things, names, units = ["opens", "closes", "drifts", "holds", "stops", "leaks", "warms", "cools"], ["valve", "pump", "gate", "filter", "sensor", "boiler", "meter", "cable"], ["Crafol", "Bentor", "Milvan", "Tarsil"], ["bar", "mm", "kg", "ms"]
    pick = lambda k: [rnd.choice(verbs if i % 2 else things) for i in range(k)]
    items, docs, want = [], [], set()
    for i in range(120):
        parts, name, unit = [" ".join(pick(6)) for _ in range(5)], rnd.choice(names), rnd.choice(units)
        ask = lambda n, a, b, c: f"{parts[0]} {n} {a} {parts[1]} {b} {unit} {parts[2]} {n} {a} {parts[3]} {c} {parts[4]}"  # noqa: E731,B023
        items.append((i, ask(name, 11, 22, 33)))
        docs.append((i, " ".join(pick(20)) + " " + ask(rnd.choice(names), 70 + i % 9, 81, 94) + " " + " ".join(pick(20))))
        docs.append((1000 + i, " ".join(pick(60))))
        docs.append((2000 + i, ask(name, 11, 22, 33)))
        want.add((i, i))
    found = {(r.item_id, r.doc_id) for r in reparameterised(spark.createDataFrame([(*r, "", "") for r in items], ITEMS), spark.createDataFrame([(*r, "", "") for r in docs], DOCS)).collect()}
    assert len(found & want) >= 0.9 * len(want)
    assert not {d for _, d in found if 1000 <= d < 2000} and not {(i, d) for i, d in found if d == 2000 + i}


def test_only_typical_words_are_names_and_units(spark):
    texts = ["The Crafol 12 runs at 40 bar between 2 and 5 mm", "Take between one and two, and Crafol 13 at 7 bar", "salt and water and sand", "Between 3 and 4 mm"]
    got = vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert "crafol" in got.names and {"bar", "mm"} <= got.units and "and" not in got.units and "between" not in got.names


def test_slots_stay_change_or_mix():
    assert consistent("a12b12", "a12b12") == "same" and consistent("a12b12", "a34b34") == "changed" and consistent("a12b12", "a34b35") == "mixed" and consistent("a12b13", "a34b34") == "mixed"
