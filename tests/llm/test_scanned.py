import random

from docloom.llm import pages as P
from docloom.llm import scanned as S

WORDS = "the archivist reports that pipeline of valve shows code when this operator is thermal and sends its message to second container before restart".split()


def model():
    texts = [" ".join(random.Random(i).choices(WORDS, k=12)).capitalize() + ". Read-only, high-capacity: 3.5 bar (see 4)." for i in range(300)] + ["主要任务与文件，定期更新。权限与日志。"] * 20
    from collections import Counter

    words, pairs, comp, ctx, han, grams = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for t in texts:
        w = S.WORD.findall(t.lower())
        words.update(x for x in w if not x.isdigit())
        pairs.update(a + " " + b for a, b in zip(w, w[1:]))
        comp.update(S.COMPOUND.findall(t.lower()))
        ctx.update(S.marks(t))
        for c in S.HAN.findall(t):
            han[c] += 1
        for run in S.re.findall("[一-鿿]+", t):
            grams.update(a + b for a, b in zip(run, run[1:]))
    return S.Model(words, {p for p in pairs if p.replace(" ", "") in words}, set(comp), set(ctx), dict(han), dict(grams))


M = model()


def fix(text):
    return S.misread(S.delined(text.split("\n"), M)[0], M)


def test_confusions_splits_merges_and_strays():
    for seen, meant in [("the arcbivist", "the archivist"), ("pipe line of", "pipeline of"), ("pipelineof valve", "pipeline of valve"), ("thc va1ve", "the valve"), ("opcrator", "operator"), ("containcr sbows", "container shows"), ("rnessage", "message"), ("contai ner", "container"), ("the valv shows", "the valve shows")]:
        assert fix("Before " + seen + " is") == (True, "Before " + meant + " is"), seen
    assert fix("the valve ~ shows code")[0] and "~" not in fix("the valve ~ shows code")[1]
    assert not fix("The archivist reports that this is thermal.")[0]
    assert not fix("Unheardofname reports code.")[0]
    assert fix("王要任务") == (True, "主要任务") and fix("主要任务") == (False, "主要任务")
    assert fix("定期更薪。权限") == (True, "定期更新。权限") and fix("主要任凹务") == (True, "主要任务")


def test_hyphens():
    assert S.broken_words(["the archi-", "vist reports"], M) == [(0, "archivist")]
    assert S.broken_words(["is read-", "only when"], M) == []
    assert S.broken_words(["the opera\xad", "tor"], M) == [(0, "operator")]
    assert S.broken_words(["code FK-", "5417"], M) == []
    assert S.broken_words(["of the contai¬"], M) == [(0, "")]
    assert fix("the archi-\nvist is read-\nonly.") == (False, "the archivist is read-only.")


def test_blocks_with_nulls_blanks_and_captions():
    assert P.judge(None, None, set(), M) == ([], None)
    assert P.judge(" \n ", [], set(), M) == ([], None)
    assert P.judge("3", None, {0}, M) == (["furniture"], None)
    kinds, text = P.judge("the opera-\n- 4 -\ntor sbows code", ["Fine.", None, "the rnessage"], {1}, M)
    assert kinds == ["furniture", "hyphen", "ocr", "caption"] and text == "the operator shows code"


def test_readings_are_those_of_generating_every_variant():
    """The lookup from both sides against the plain generation of all readings."""

    def plain(w):
        one = set(S._confused(w, S.CONFUSED))
        out = {(3.0, v) for v in one} | {(6.0, x) for v in one for x in S._confused(v, S.CONFUSED[:24])}
        if len(w) >= 4:
            out |= {(5.0, w[:i] + w[i + 1 :]) for i in range(len(w))}
            out |= {(6.0, w[:i] + c + w[i + 1 :]) for i in range(len(w)) for c in S.ALPHABET}
            out |= {(5.0, w[:i] + c + w[i:]) for i in range(len(w) + 1) for c in S.ALPHABET}
        return min(((c + M.cost(v), v) for c, v in out if len(v) > 1 and M.known(v)), default=None)

    rnd = random.Random(3)
    for _ in range(600):
        w = rnd.choice(WORDS)
        for _ in range(rnd.randrange(1, 3)):
            i = rnd.randrange(len(w) + 1)
            a, b = rnd.choice(S.CONFUSED)
            w = rnd.choice([w.replace(b, a, 1), w[:i] + rnd.choice("abcü1") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyz") + w[i + 1 :]])
        if w and not M.known(w):
            want, got = plain(w), M.word(w)
            assert got == (None if want is None else (want[0] - M.cost(want[1]), want[1])), w


def test_words_broken_between_blocks_are_joined(spark):
    rows = [("d", 3, "a", 0, False, P.judge("the archi-", None, set(), M)[1]), ("d", 9, "b", 1, False, P.judge("vist reports that", None, set(), M)[1]), ("d", 600, "c", 2, True, "Notes"), ("e", None, "x", None, False, "水泵"), ("e", 5, "y", 3, False, "运行")]
    df = spark.createDataFrame(rows, "document_id string, block_no int, block_id string, page_idx int, leveled boolean, repaired string")
    got = sorted((r.document_id, r.paragraph_no, r.page_from, r.page_to, tuple(r.block_ids), r.text) for r in P.paragraphs(df).collect())
    assert got == [("d", 0, 0, 1, ("a", "b"), "the archivist reports that"), ("d", 1, 2, 2, ("c",), "Notes"), ("e", 0, 0, 3, ("x", "y"), "水泵运行")]


def test_paragraphs_do_not_depend_on_spans(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [("d", i, f"b{i:04}", i // 9, rnd.random() < 0.05, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 30))) + rnd.choice([".", "", ","])) for i in range(400)]
    df = spark.createDataFrame(rows, "document_id string, block_no int, block_id string, page_idx int, leveled boolean, repaired string")
    whole = sorted((r.paragraph_no, tuple(r.block_ids)) for r in P.paragraphs(df).collect())
    monkeypatch.setattr(P, "SPAN", 64)
    monkeypatch.setattr(P, "HALO", 32)
    assert sorted((r.paragraph_no, tuple(r.block_ids)) for r in P.paragraphs(df).collect()) == whole
    assert [b for _, bs in whole for b in bs] == [r[2] for r in rows]


def test_dynamic_programme_equals_trying_everything():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        texts = ["x" * rnd.randrange(1, 60) + rnd.choice([".", ""]) for _ in range(n)]
        levels, pages = [rnd.random() < 0.2 for _ in range(n)], sorted(rnd.randrange(3) for _ in range(n))

        def cost(starts):
            total = 0.0
            for k, a in enumerate(starts):
                z = starts[k + 1] if k + 1 < len(starts) else n
                pair = lambda i: P.paragraph_cost(texts[i - 1], texts[i], levels[i] or levels[i - 1], pages[i] == pages[i - 1])  # noqa: E731,B023
                total += (pair(a)[1] if a else 0) + sum(pair(i)[0] for i in range(a + 1, z)) + max(0.0, sum(len(t) for t in texts[a:z]) - 50) / 50
            return total

        every = [[0] + [i + 1 for i in range(n - 1) if m >> i & 1] for m in range(1 << (n - 1))]
        assert abs(cost(P.boundaries(texts, levels, pages, 50)) - min(map(cost, every))) < 1e-9


def test_paragraphs_by_dynamic_programming():
    texts = ["The valve shows", "code when this operator is thermal.", "Notes", "A new start."]
    assert P.boundaries(texts, [False, False, True, False], [0, 1, 1, 1]) == [0, 2, 3]
    assert P.boundaries([], [], []) == []


BLOCKS = "block_id string, document_id string, block_no int, page_idx int, block_type string, text_level int, text string, image_caption array<string>, key string"


def test_running_lines_and_page_numbers(spark):
    rows = []
    for p in range(6):
        rows.append((f"h{p}", "d", 10 * p, p, "text", 1 if p == 2 else None, f"{p}  Manual of the pump" if p != 4 else "4 Manual of thc purnp", None, ""))
        rows.append((f"b{p}", "d", 10 * p + 1, p, "text", None, f"Body {'abcdef'[p] * 9} says something\n- {p} -\nand ends here {'x' * p}.", None, ""))
        rows.append((f"n{p}", "d", 10 * p + 2, p, "text", 2, "Notes", None, ""))
        rows.append((f"t{p}", "d", 10 * p + 3, p, "table", None, str(p), None, ""))
    rows += [("z", "e", 1, 0, "text", None, None, None, ""), ("y", None, 1, 0, "text", None, "7", None, "")]
    got = {r.block_id: list(r.furniture) for r in P.furniture(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {**{f"h{p}": [0] for p in range(6)}, **{f"b{p}": [1] for p in range(6)}}


def test_no_blocks(spark):
    none = spark.createDataFrame([], BLOCKS)
    found = P.furniture(none)
    assert found.count() == 0 and P.noisy_documents(none, found).count() == 0
    assert P.learn(none.select("text"), none.select("text")).value.words == {}
