import random

import numpy as np

from docloom.llm import spans as S
from docloom.llm.automaton import SuffixAutomaton
from docloom.llm.windows import codes, window_hashes, window_minima

DOCS = "doc_id bigint, text string, anchor string, region string"


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_automaton_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        refs = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(4)]
        text = "".join(rnd.choice("abc") for _ in range(15))
        sam = SuffixAutomaton(refs)
        for least in (1, 2, 4):
            got = {}
            for end, n, state in sam.stream(text, least):
                assert n == max(k for k in range(1, end + 1) if any(text[end - k : end] in r for r in refs))
                assert sam.texts_of(state) == {i for i, r in enumerate(refs) if text[end - least : end] in r}
                got[end] = n
            want = {e for e in range(least, len(text) + 1) if any(text[e - least : e] in r for r in refs)}
            assert set(got) == want


def test_window_hashes_and_minima():
    x = codes("abcabcabc" * 20)
    for w in (1, 2, 3, 5, 7, 50):
        h = window_hashes(x, w)
        assert len(h) == len(x) - w + 1
        assert len(set(h.tolist())) == len({bytes(x[i : i + w]) for i in range(len(h))})
    v = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    picked = set(window_minima(v, 40).tolist())
    for i in range(len(v) - 39):
        assert picked & set(range(i, i + 40))


def documents():
    rnd = random.Random(4)
    rand = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = [rand(n) for n in (299, 300, 301, 700)]
    rows = [(i, rand(rnd.randrange(400)) + shared[i % 4] + rand(rnd.randrange(400))) for i in range(16)]
    footer = rand(260)
    rows += [(100 + i, rand(500) + footer) for i in range(30)]
    rows += [(200, "z" * 900), (201, "y" + "z" * 310), (300, None), (301, ""), (302, rows[0][1]), (303, rows[0][1])]
    return rows


def test_pairs_and_shared_parts(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "", "") for r in rows], DOCS)
    found = S.shared_regions(df)
    for size in (400, 3):
        S.SHARD, keep = size, S.SHARD
        m = S.matches(found)
        got = {(r.doc_a, r.doc_b) for r in S.sharing_pairs(found, m).collect()}
        parts = {}
        for r in S.merged(S.shared_parts(found, m)).collect():
            parts.setdefault(r.doc_id, []).append((r.begin, r.end))
        S.SHARD = keep
        text = {d: t for d, t in rows if t and len(t) >= 300}
        where = {}
        for d, t in text.items():
            for p in range(len(t) - 299):
                where.setdefault(t[p : p + 300], set()).add(d)
        want = {(a, b) for v in where.values() for a in v for b in v if a < b}
        assert got == want
        for d, t in text.items():
            cover = set()
            for p in range(len(t) - 299):
                if len(where[t[p : p + 300]]) > 1:
                    cover |= set(range(p, p + 300))
            assert cover == {i for a, z in parts.get(d, []) for i in range(a, z)}, d
        left = {r.doc_id: r for r in S.cleaned(df, S.merged(S.shared_parts(found, m))).collect()}
        for d, t in rows:
            gone = {i for a, z in parts.get(d, []) for i in range(a, z)}
            assert left[d].text == (None if t is None else "".join(c for i, c in enumerate(t) if i not in gone)) and left[d].n_removed == len(gone)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    found = S.shared_regions(df)
    assert S.sharing_pairs(found, S.matches(found)).count() == 0
