"""Evaluation texts leaking into training text, by template canonicalisation.

Texts are put in lower case and stripped of all but letters and digits. Numbers, names and units are then
replaced by typed placeholders, windows of the resulting template are hash-joined between items and
documents, and matches are judged on the characters behind them: a verbatim run of ``RUN`` characters
is a leak; a template run whose slots differ consistently is a re-parameterised question.

Exactness of the verbatim result: placeholders keep the length of what they replace and depend only on
``REACH`` characters around, so the inside of a common run has a common template there; document windows are
taken every ``STEP`` characters such that one lies inside any run of ``RUN``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.windows import codes, window_hashes
from docloom.runtime import materialize, small

RUN = 100
#: Longest name or unit that is masked; longer ones stand as they are.
REACH = 12
WINDOW = 56
STEP = RUN - 2 * REACH - WINDOW + 1
#: Least and greatest size, as powers of two, of the bitmap of item windows that documents are tested against before the join: sixteen bits to a
#: window, 32 MB at most. Beyond some sixteen million windows it lets more and more pass, and the join settles it.
LEAST_BITS, MOST_BITS = 20, 28
DROP = re.compile(r"[\W_]+")
NAMED = re.compile(r"\b([A-Z][a-z]{2,11})(?= (?:Mk )?[A-Z]?\d)")
UNIT = re.compile(r"\d ?([a-zA-Z]{1,12})\b")
#: Share of a word's occurrences that must stand in the place of a name or unit: words that also stand elsewhere are words.
TYPICAL = 0.5
NUMBER, NAME, UNITS = ord("0"), 0xE001, 0xE002

TOKENS = 16
WORD = re.compile(r"[A-Za-z]+-?\d[\w.-]*|\d+(?:[.,]\d+)*|[^\W\d_]+|_")


def strip(text: str | None) -> str:
    """Lower case, letters and digits only."""
    return DROP.sub("", (text or "").lower())


class Canonical:
    """Typed placeholders learnt from the items: names stand before a model number, units after a number."""

    def __init__(self, names: list[str], units: list[str]):
        import ahocorasick

        self.names, self.units = set(names), set(units)
        self.auto = ahocorasick.Automaton()
        for word, kind in [*((w, NAME) for w in sorted(self.names)), *((w, UNITS) for w in sorted(self.units - self.names))]:
            self.auto.add_word(word, (len(word), kind))
        self.any = bool(self.names or self.units)
        if self.any:
            self.auto.make_automaton()

    def template(self, text: str) -> np.ndarray:
        """Characters of a stripped text with digits, names and units masked in place."""
        chars = codes(text).copy()
        digit = np.fromiter((c.isdigit() for c in text), bool, len(text)) if not text.isascii() else (chars >= 48) & (chars <= 57)
        if self.any:
            for end, (n, kind) in self.auto.iter(text):
                begin = end - n + 1
                if kind == NAME or (begin and digit[begin - 1]):
                    chars[begin : end + 1] = kind
        chars[digit] = NUMBER
        return chars

    def tokens(self, text: str) -> tuple[list[str], list[str]]:
        """Template tokens and the raw words behind them; a number, name or unit is one typed token."""
        raw = WORD.findall(text or "")
        out = []
        for i, w in enumerate(raw):
            low = w.lower()
            if any(c.isdigit() for c in w):
                out.append("<code>" if w[0].isalpha() else "<num>")
            elif low in self.names:
                out.append("<name>")
            elif low in self.units and i and out[-1] == "<num>":
                out.append("<unit>")
            else:
                out.append(low)
        return out, raw


def vocabulary(items: DataFrame, most: int = 200_000) -> Canonical:
    """Names and units that the items use: words that stand before a model number, or after a number, in at least TYPICAL of
    their occurrences. The words are counted in the cluster; more than ``most`` are refused."""

    def find(batches):
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                found.update(("n", w.lower()) for w in NAMED.findall(t or ""))
                found.update(("u", w.lower()) for w in UNIT.findall(t or ""))
                found.update(("w", w.lower()) for w in re.findall(r"[a-zA-Z]{1,12}", t or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "word", "n"])

    counts = items.select("text").mapInArrow(find, "kind string, word string, n bigint").groupBy("word").pivot("kind", ["n", "u", "w"]).sum("n")
    typical = lambda k: F.coalesce(F.col(k), F.lit(0)) >= F.greatest(F.lit(1), TYPICAL * F.coalesce("w", F.lit(0)))
    rows = counts.select("word", typical("n").alias("named"), typical("u").alias("unit")).where("named or unit").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names and units")
    return Canonical([r.word for r in rows if r.named], [r.word for r in rows if r.unit])


def _char_windows(df: DataFrame, key: str, canon: Canonical, step: int, bitmap=None) -> DataFrame:
    """(key, h, before, inside, after): template windows with the plain characters inside and up to RUN-WINDOW around."""
    ext = RUN - WINDOW
    names, units = sorted(canon.names), sorted(canon.units)

    def run(batches):
        local = Canonical(names, units)
        bits = None if bitmap is None else bitmap.value
        for b in batches:
            keys, hs, before, inside, after = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = strip(t)
                if len(s) < RUN:
                    continue
                h = window_hashes(local.template(s), WINDOW)[::step]
                at = np.arange(len(h)) * step
                if bits is not None:
                    hit = _passing(h, bits)
                    h, at = h[hit], at[hit]
                for x, p in zip(h.view(np.int64).tolist(), at.tolist()):
                    keys.append(k)
                    hs.append(x)
                    before.append(s[max(0, p - ext) : p])
                    inside.append(s[p : p + WINDOW])
                    after.append(s[p + WINDOW : p + WINDOW + ext])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hs, pa.int64()), pa.array(before, pa.string()), pa.array(inside, pa.string()), pa.array(after, pa.string())], names=["key", "h", "before", "inside", "after"])

    return df.where("text is not null").select(F.col(key).cast("bigint").alias("key"), "text").where("key is not null").mapInArrow(run, "key bigint, h bigint, before string, inside string, after string")


def _bitmap(windows: DataFrame):
    """Broadcast (bits, bitmap) of window hashes, put together in the cluster in pieces of 4 KB."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * windows.count()).bit_length()))

    def piece(t: pa.Table) -> pa.Table:
        at = t.column("slot").to_numpy() & 32767
        out = np.zeros(4096, np.uint8)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int32()), "bytes": pa.array([out.tobytes()], pa.binary())})

    slots = windows.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")).distinct().withColumn("piece", F.shiftright("slot", 15))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.groupBy("piece").applyInArrow(piece, "piece int, bytes binary").collect():
        table[r.piece << 12 : (r.piece + 1) << 12] = np.frombuffer(r.bytes, np.uint8)
    return windows.sparkSession.sparkContext.broadcast((bits, table))


def _passing(h: np.ndarray, bitmap: tuple[int, np.ndarray]) -> np.ndarray:
    bits, table = bitmap
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return ((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) == 1


def common_run(b1: str, a1: str, b2: str, a2: str) -> int:
    """Characters that two equal windows share beyond themselves, as far as their contexts show it."""
    left = right = 0
    while left < min(len(b1), len(b2)) and b1[-1 - left] == b2[-1 - left]:
        left += 1
    while right < min(len(a1), len(a2)) and a1[right] == a2[right]:
        right += 1
    return left + right


def consistent(item: str, doc: str) -> str:
    """How the slots of two windows of one template differ: 'same' where every value stays as it is, 'changed' where one value always
    becomes the same other one and the reverse, else 'mixed'. Windows have equal lengths; runs of characters that differ are the slots."""
    if item == doc:
        return "same"
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for m in re.finditer(r"\d+|[^\W\d_]+", item):
        a, b = m.group(), doc[m.start() : m.end()]
        if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return "mixed"
    return "changed"


def leaks(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Distinct (item_id, doc_id) whose stripped texts share at least ``RUN`` characters in one run.

    Null ids and texts, and texts of fewer characters, take no part. Extra columns are ignored.
    """
    canon = vocabulary(items)
    left = materialize(_char_windows(items.select(F.col(item_id).alias("k"), "text"), "k", canon, 1))
    right = _char_windows(docs.select(F.col(doc_id).alias("k"), "text"), "k", canon, STEP, _bitmap(left))
    pairs = right.select(F.col("key").alias("doc_id"), "h", F.col("before").alias("b2"), F.col("inside").alias("i2"), F.col("after").alias("a2")).join(small(left.withColumnRenamed("key", "item_id")), "h")

    def judge(batches):
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            found = {
                (it, d)
                for it, d, b1, i1, a1, b2, i2, a2 in zip(c["item_id"], c["doc_id"], c["before"], c["inside"], c["after"], c["b2"], c["i2"], c["a2"])
                if consistent(i1, i2) == "same" and len(i1) + common_run(b1, a1, b2, a2) >= RUN
            }
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["item_id", "doc_id"])

    return pairs.select("item_id", "doc_id", "before", "inside", "after", "b2", "i2", "a2").mapInArrow(judge, "item_id bigint, doc_id bigint").distinct()


def _token_windows(df: DataFrame, key: str, canon: Canonical, bitmap=None) -> DataFrame:
    """(key, h, slots): windows of TOKENS template tokens with at least four slots' room, and their slot values."""
    names, units = sorted(canon.names), sorted(canon.units)

    def run(batches):
        local = Canonical(names, units)
        bits = None if bitmap is None else bitmap.value
        seen: dict[str, int] = {}
        for b in batches:
            keys, hs, slots = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens, raw = local.tokens(t)
                if len(tokens) < TOKENS:
                    continue
                ids = np.array([seen.get(w) or seen.setdefault(w, hash_word(w)) for w in tokens], np.uint64)
                h = window_hashes(ids, TOKENS)
                at = np.arange(len(h)) if bits is None else np.nonzero(_passing(h, bits))[0]
                for p in at.tolist():
                    values = [raw[j] for j in range(p, p + TOKENS) if tokens[j][0] == "<"]
                    if values and TOKENS - len(values) >= TOKENS // 2:
                        keys.append(k)
                        hs.append(int(h[p].view(np.int64)))
                        slots.append(values)
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hs, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["key", "h", "slots"])

    return df.where("text is not null").select(F.col(key).cast("bigint").alias("key"), "text").where("key is not null").mapInArrow(run, "key bigint, h bigint, slots array<string>")


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) | 1


def reparameterised(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """(item_id, doc_id, n_windows, n_slots, n_changed): documents that ask an item's question with other values.

    A template window counts when its slot values are consistent: one item value always becomes the same
    document value and the reverse. At least one value must differ; unchanged copies are :func:`leaks`.
    """
    canon = vocabulary(items)
    left = materialize(_token_windows(items.select(F.col(item_id).alias("k"), "text"), "k", canon))
    right = _token_windows(docs.select(F.col(doc_id).alias("k"), "text"), "k", canon, _bitmap(left))
    pairs = right.select(F.col("key").alias("doc_id"), "h", F.col("slots").alias("_d")).join(small(left.select(F.col("key").alias("item_id"), "h", F.col("slots").alias("_i"))), "h")
    both = F.arrays_zip("_i", "_d")
    judged = pairs.where(F.size("_i") == F.size("_d")).withColumn("_z", F.array_distinct(both)).withColumn(
        "_ok", (F.size("_z") == F.size(F.array_distinct("_i"))) & (F.size("_z") == F.size(F.array_distinct("_d")))
    )
    changed = F.size(F.filter("_z", lambda z: z["_i"] != z["_d"]))
    return (
        judged.withColumn("_c", changed)
        .where("_ok and _c > 0")
        .groupBy("item_id", "doc_id")
        .agg(F.count("*").alias("n_windows"), F.max(F.size("_z")).alias("n_slots"), F.max("_c").alias("n_changed"))
    )
