"""Filling fixed-capacity containers with items, by lexical retrieval packing.

Items of a collection (a document) are indexed in shards of at most ``SHARD`` items: an inverted BM25 index
returns, for the largest unused seed, its unused neighbours, which fill the seed's window greedily; room
that no neighbour fits goes to the largest item that does. A shard is a bounded piece of one collection in
reading order, so a collection that holds a third of all rows is packed by as many tasks as it has shards.

An exact step follows: where the count found is above the smallest conceivable one, branch and bound looks
for a packing with fewer containers than filling in reading order needs. What it finds replaces the packing, so the
containers that are emitted are those that were counted.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize

SHARD = 512
#: Shards of one collection that a task puts together; more go in tiers.
FAN = 64
K1, B = 1.2, 0.75
WORD = re.compile(r"\w+")
#: Steps of branch and bound for one collection before the histogram bound decides.
STEPS = 400_000


def next_fit(sizes, cap: int) -> int:
    """Containers that filling in reading order opens."""
    n, room = 0, -1
    for s in sizes:
        if s > room:
            n, room = n + 1, cap
        room -= s
    return n


def next_fit_map(sizes, cap: int) -> list[tuple[int, int, int]]:
    """A shard as a function of the room it is entered with: [(least room, opened, room left)], least room ascending.

    Within one entry all sizes up to the first that does not fit are put into the open container, so
    the room left differs by the room entered with only when nothing is opened (opened 0: room left is
    entered room minus the shard's sum, stored as -sum).
    """
    out, total = [], 0
    for i, s in enumerate(sizes):
        # entered with room in [total, total + s): item i is the first that opens a container
        n, room = 0, -1
        for t in sizes[i:]:
            if t > room:
                n, room = n + 1, cap
            room -= t
        out.append((total, n, room))
        total += s
        if total > cap:
            return out
    out.append((total, 0, -total))
    return out


def joined_maps(first: list, second: list) -> list[tuple[int, int, int]]:
    """The map of two neighbouring shards, from those of both. Rooms are never above the capacity, so rooms that no container has need no entry."""
    if not first or not second:
        return first or second
    out = []
    for least, n, left in first:
        if n:
            more = next(e for e in reversed(second) if e[0] <= left)
            out.append((least, n + more[1], more[2] if more[1] else left + more[2]))
        else:  # -left was put into the open container, and what is left of it meets the second shard
            out.extend((least + e[0], e[1], e[2] if e[1] else left + e[2]) for e in second)
    return out


def chain(maps) -> int:
    """Containers of a whole collection from the maps of its shards, in order."""
    n, room = 0, -1
    for entries in maps:
        if not entries:
            continue
        if room < 0:
            pick = entries[0]
        else:
            pick = next(e for e in reversed(entries) if e[0] <= room)
        n += pick[1]
        room = pick[2] if pick[1] else room + pick[2]
    return n


class Bm25:
    """Inverted index over one shard."""

    def __init__(self, texts: list[str]):
        self.terms = [Counter(WORD.findall(t.lower())) for t in texts]
        self.length = [sum(c.values()) for c in self.terms]
        mean = (sum(self.length) / len(texts) if texts else 0) or 1.0
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(self.terms):
            norm = K1 * (1 - B + B * self.length[i] / mean)
            for t, f in c.items():
                self.postings.setdefault(t, []).append((i, f * (K1 + 1) / (f + norm)))
        n = len(texts)
        self.idf = {t: math.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5)) for t, p in self.postings.items()}

    def neighbours(self, seed: int, unused: set[int]) -> list[int]:
        """Unused items that share a term with ``seed``, best first; ties in item order."""
        score: dict[int, float] = {}
        for t in self.terms[seed]:
            w = self.idf[t]
            for i, x in self.postings[t]:
                if i in unused:
                    score[i] = score.get(i, 0.0) + w * x
        return sorted(score, key=lambda i: (-score[i], i))


def pack_shard(sizes: list[int], texts: list[str], cap: int, least: int = 0) -> list[list[int]]:
    """Containers (lists of positions) for items of 1..cap tokens; none is split, none exceeds ``cap``.

    A last container below ``least`` tokens is emptied into others when they have room.
    """
    index = Bm25(texts)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    unused = set(order)
    bins = []
    for seed in order:
        if seed not in unused:
            continue
        unused.discard(seed)
        room, box = cap - sizes[seed], [seed]
        smallest = min((sizes[i] for i in unused), default=cap + 1)
        if room >= smallest:
            for i in index.neighbours(seed, unused):
                if sizes[i] <= room:
                    box.append(i)
                    unused.discard(i)
                    room -= sizes[i]
                    if room < smallest:
                        break
            if room >= smallest:
                for i in order:
                    if i in unused and sizes[i] <= room:
                        box.append(i)
                        unused.discard(i)
                        room -= sizes[i]
        bins.append(box)
    return tidy(bins, sizes, cap, least)


def tidy(bins: list[list[int]], sizes: list[int], cap: int, least: int) -> list[list[int]]:
    """Empty containers below ``least`` into the fullest ones that can take their items."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    for k in sorted(range(len(bins)), key=lambda k: fills[k]):
        if not 0 < fills[k] < least:
            continue
        moves, tried = [], fills.copy()
        for i in sorted(bins[k], key=lambda i: -sizes[i]):
            to = max((j for j in range(len(bins)) if j != k and bins[j] and tried[j] + sizes[i] <= cap), key=lambda j: tried[j], default=None)
            if to is None:
                break
            tried[to] += sizes[i]
            moves.append((i, to))
        else:
            for i, to in moves:
                bins[to].append(i)
                fills[to] += sizes[i]
            bins[k], fills[k] = [], 0
    return [sorted(b) for b in bins if b]


def lower_bound(sizes: list[int], cap: int) -> int:
    """The larger of the sum bound and the two-class bounds over all thresholds up to half the capacity."""
    s = sorted(sizes, reverse=True)
    best = -(-sum(s) // cap)
    for k in {x for x in s if x <= cap // 2}:
        big = [x for x in s if x > cap - k]
        mid = [x for x in s if cap - k >= x > cap / 2]
        low = sum(x for x in s if cap / 2 >= x >= k)
        best = max(best, len(big) + len(mid) + max(0, -(-(low - (len(mid) * cap - sum(mid))) // cap)))
    return max(best, sum(1 for x in s if x > cap / 2))


def fits(sizes: list[int], cap: int, bins: int) -> list[list[int]] | None:
    """What ``search`` finds."""
    return search(sizes, cap, bins)[0]


def search(sizes: list[int], cap: int, bins: int, steps: int = STEPS) -> tuple[list[list[int]] | None, bool]:
    """(distribution of all items over ``bins`` containers by branch and bound or None, whether the search gave up).

    Items go in by falling size; equal rooms and equal items are tried once (symmetry); a branch ends when the
    waste exceeds what the sum leaves. After ``steps`` steps the search gives up.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    slack = bins * cap - sum(sizes)
    if slack < 0:
        return None, False
    room, where, left = [cap] * bins, [0] * len(sizes), [steps]
    n = len(order)
    smallest = sizes[order[-1]] if n else 0

    def put(k: int, wasted: int) -> bool:
        if k == n:
            return True
        left[0] -= 1
        if left[0] < 0:
            return False
        i = order[k]
        s = sizes[i]
        before = where[order[k - 1]] if k else 0
        # equal items go to containers in rising order, unless the one before was tried in a single place only
        start = before if k and sizes[order[k - 1]] == s and room[before] else 0
        seen = set()
        for b in sorted(range(start, bins), key=lambda b: (room[b], b)):
            r = room[b]
            if r < s or r in seen:
                continue
            seen.add(r)
            after = r - s
            more = after if after < smallest else 0
            if wasted + more > slack:
                continue
            room[b], where[i] = after, b
            if put(k + 1, wasted + more):
                return True
            room[b] = r
            if r == cap or after == 0:  # an empty container, or a perfect fit, need not be tried otherwise
                break
        return False

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * n + 1000))
    if not put(0, 0):
        return None, left[0] < 0
    out: list[list[int]] = [[] for _ in range(bins)]
    for i in range(n):
        out[where[i]].append(i)
    return [b for b in out if b], False


SHARDS = "collection string, shard bigint, cap int, n_items bigint, n_bins bigint, fit_map string, histogram string, bins string"


def pack_shards(items: DataFrame) -> DataFrame:
    """Pack every shard. ``items``: collection, item, position, size, cap, least, text.

    Takes part: items of 1..cap tokens with a collection; a null text still counts with its size but has no
    terms. Items equal in position are ordered by id. Repeated item ids must have been removed.
    """
    ok = items.where("collection is not null and size between 1 and cap")
    spread = ok.groupBy("collection").agg(F.count("*").alias("_n"))
    hot = spread.where(F.col("_n") > SHARD)
    # positions run over a window per collection; only what exceeds one shard needs it, in ranges of its position
    ranked = _ranks(ok, hot)
    grouped = ranked.groupBy("collection", "shard").agg(
        F.max("cap").alias("cap"), F.max("least").alias("least"), F.array_sort(F.collect_list(F.struct("position", "item", "size", F.coalesce("text", F.lit("")).alias("text")))).alias("items")
    )

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sizes, cap = [x["size"] for x in r["items"]], r["cap"]
                ids = [x["item"] for x in r["items"]]
                bins = pack_shard(sizes, [x["text"] for x in r["items"]], cap, r["least"])
                rows.append((r["collection"], r["shard"], cap, len(ids), len(bins), json.dumps(next_fit_map(sizes, cap)), json.dumps(sorted(Counter(sizes).items())), json.dumps([[ids[i] for i in box] for box in bins])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return grouped.mapInArrow(run, SHARDS)


_NAMES = ["collection", "shard", "cap", "n_items", "n_bins", "fit_map", "histogram", "bins"]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _ranks(items: DataFrame, hot: DataFrame) -> DataFrame:
    """``shard`` per item: 0 in ordinary collections; consecutive runs of positions in large ones.

    Large collections are cut by value ranges of their position whose counts are at most a shard, found from counts per
    position. These are summed per stretch of positions first and then inside each stretch, so that no window holds a collection.
    """
    cold = items.join(hot.select("collection"), "collection", "left_anti").withColumn("shard", F.lit(0).cast("bigint"))
    large = items.join(hot.select("collection"), "collection", "left_semi")
    stretch = F.coalesce(F.floor(F.col("position") / 4096), F.lit(-(1 << 40)))
    counts = large.groupBy("collection", "position").agg(F.count("*").alias("_c")).withColumn("_t", stretch)
    w = Window.partitionBy("collection").orderBy("_t")
    upper = counts.groupBy("collection", "_t").agg(F.sum("_c").alias("_tc")).select("collection", "_t", (F.sum("_tc").over(w) - F.col("_tc")).alias("_upper"))
    inside = Window.partitionBy("collection", "_t").orderBy(F.col("position").asc_nulls_first())
    upto = counts.withColumn("_inside", F.sum("_c").over(inside) - F.col("_c")).join(upper, ["collection", "_t"]).withColumn("_before", F.col("_inside") + F.col("_upper"))
    cut = upto.select("collection", F.col("position").alias("_p"), (F.floor(F.col("_before") / (SHARD // 2)) * (1 << 32)).alias("_s"), F.floor((F.col("_c") - 1) / (SHARD // 2)).alias("_more"))
    placed = large.join(cut, (large["collection"] == cut["collection"]) & large["position"].eqNullSafe(cut["_p"])).drop(cut["collection"])
    # more equal positions than a shard holds: spread by id, still in a fixed order
    return cold.unionByName(placed.withColumn("shard", F.col("_s") + F.when(F.col("_more") > 0, F.pmod(F.xxhash64("item"), F.col("_more") + 1)).otherwise(F.lit(0))).drop("_p", "_s", "_more"))


_PARTS = "collection string, shard bigint, cap int, n_items bigint, n_bins bigint, fit_map string, histogram string"
_BOXES = pa.list_(pa.struct([("times", pa.int64()), ("sizes", pa.list_(pa.int32()))]))


def _summed(parts) -> Counter:
    hist: Counter = Counter()
    for p in parts:
        for s, n in json.loads(p["histogram"]):
            hist[s] += n
    return hist


def _in_tiers(parts: DataFrame) -> DataFrame:
    """parts with at most FAN shards to a collection: neighbours are joined as long as there are more."""
    listed = F.array_sort(F.collect_list(F.struct("shard", "fit_map", "histogram"))).alias("parts")

    def join(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at: list = []
                for p in r["parts"]:
                    at = joined_maps(at, json.loads(p["fit_map"]))
                    at = [e for e in at if e[0] <= r["cap"]]
                rows.append((r["collection"], r["shard"], r["cap"], r["n_items"], r["n_bins"], json.dumps(at), json.dumps(sorted(_summed(r["parts"]).items()))))
            types = _TYPES[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=_NAMES[:-1])

    while True:
        per = parts.groupBy("collection").agg(F.count("*").alias("_c"), F.max("shard").alias("_m"))
        most = per.agg(F.max("_c").alias("c"), F.max("_m").alias("m")).first()
        if (most.c or 0) <= FAN:
            return parts
        # names of shards are sparse: those above 32 bits count blocks of half a shard, the rest tells equal positions apart
        step = (1 << 32) if most.m >= 1 << 32 and parts.where(F.pmod("shard", F.lit(1 << 32)) > 0).isEmpty() else 1
        key = F.floor(F.col("shard") / (step * FAN)) if step > 1 else F.floor(F.col("shard") / FAN)
        parts = materialize(parts.groupBy("collection", key.alias("_k")).agg(F.max("cap").alias("cap"), F.sum("n_items").alias("n_items"), F.sum("n_bins").alias("n_bins"), listed)
                            .select("collection", (F.col("_k") * step).alias("shard"), "cap", "n_items", "n_bins", "parts").mapInArrow(join, _PARTS))


def collections(shards: DataFrame) -> DataFrame:
    """(collection, cap, n_items, n_packed, n_reading, n_best, fewer, undecided, better): containers per collection.

    n_packed: retrieval packing; n_reading: filling in reading order; n_best: after the exact step, whose containers are ``better``
    (sizes, and how many containers hold just these), null where it did not improve on the retrieval packing. Collections
    of many shards join the shards' maps in tiers; their exact step works on the histogram of sizes, at most
    ``cap`` numbers however many items there are. ``undecided`` marks collections for which neither fewer containers than in reading order
    were found nor the lower bound or a complete search excludes them.
    """
    parts = _in_tiers(shards.select(*_NAMES[:-1])).groupBy("collection").agg(
        F.max("cap").alias("cap"), F.sum("n_items").alias("n_items"), F.sum("n_bins").alias("n_packed"), F.array_sort(F.collect_list(F.struct("shard", "fit_map", "histogram"))).alias("parts")
    )
    schema = "collection string, cap int, n_items bigint, n_packed bigint, n_reading bigint, n_best bigint, fewer boolean, undecided boolean, better array<struct<times:bigint,sizes:array<int>>>"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                cap = r["cap"]
                reading = chain(json.loads(p["fit_map"]) for p in r["parts"])
                best, undecided, better = r["n_packed"], False, None
                if best >= reading > 1:
                    hist = _summed(r["parts"])
                    if _least_bins(hist, cap) < reading:
                        better, undecided = _improved(hist, cap, reading, r["n_items"])
                        if better is not None:
                            best = sum(n for n, _ in better)
                rows.append((r["collection"], cap, r["n_items"], r["n_packed"], reading, min(best, reading), best < reading, undecided, better))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), _BOXES]
            names = ["collection", "cap", "n_items", "n_packed", "n_reading", "n_best", "fewer", "undecided", "better"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return parts.mapInArrow(run, schema)


def _improved(hist: Counter, cap: int, reading: int, n_items: int) -> tuple[list[tuple[int, list[int]]] | None, bool]:
    """(containers as (times, sizes), fewer than ``reading``, or None; whether that stays open)."""
    if n_items <= 4 * SHARD:
        sizes = sorted(hist.elements(), reverse=True)
        boxes, gave_up = search(sizes, cap, reading - 1)
        if boxes is not None:
            return [(1, [sizes[i] for i in b]) for b in boxes], False
        if not gave_up:
            return None, False
    for boxes in (_first_fit(hist, cap), _pattern_fill(hist, cap, reading - 1)):
        if sum(n for n, _ in boxes) < reading:
            return boxes, False
    return None, True


def _first_fit(hist: Counter, cap: int) -> list[tuple[int, list[int]]]:
    """First fit decreasing on a histogram: containers of equal content are one entry (times, sizes), so the work depends on ``cap`` only."""
    groups: list[list] = []  # [room, times, sizes], the fullest first where they are looked for
    for s in sorted(hist, reverse=True):
        left, fresh = hist[s], []
        for g in sorted((g for g in groups if g[0] >= s), key=lambda g: g[0]):
            per = g[0] // s
            full, rest = divmod(min(left, per * g[1]), per)
            left -= full * per + rest
            g[1] -= full + (1 if rest else 0)
            fresh += [[g[0] - n * s, times, g[2] + [s] * n] for n, times in ((per, full), (rest, 1 if rest else 0)) if times]
            if not left:
                break
        if left:
            per = cap // s
            full, rest = divmod(left, per)
            fresh += [[cap - n * s, times, [s] * n] for n, times in ((per, full), (rest, 1 if rest else 0)) if times]
        groups = [g for g in groups if g[1]] + fresh
    return [(times, sizes) for _, times, sizes in groups]


def _least_bins(hist: Counter, cap: int) -> int:
    """``lower_bound`` of a histogram."""
    rows = sorted((s, n) for s, n in hist.items() if n)
    best = max(-(-sum(s * n for s, n in rows) // cap), sum(n for s, n in rows if 2 * s > cap))
    for k in (s for s, _ in rows if s <= cap // 2):
        big = sum(n for s, n in rows if s > cap - k)
        mid = [(s, n) for s, n in rows if cap - k >= s and 2 * s > cap]
        low = sum(s * n for s, n in rows if 2 * s <= cap and s >= k)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(low - sum((cap - s) * n for s, n in mid)) // cap)))
    return best


def _pattern(rows: list[tuple[int, int]], room: int) -> Counter:
    """The fullest choice of the sizes (size, count) within ``room``, by reachable sums as bits."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for s, n in rows:
        n, k = min(n, room // s), 1
        while n > 0:
            k = min(k, n)
            steps.append((s, k, reach))
            reach |= reach << s * k & mask
            n, k = n - k, 2 * k
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, Counter()
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            out[s] += k
            at -= s * k
    return out


def _pattern_fill(hist: Counter, cap: int, most: int) -> list[tuple[int, list[int]]]:
    """Containers (times, sizes) when the largest size left is always filled up best, as often as the counts allow. Once at most 4 * SHARD items are
    left, ``fits`` searches them for what is left of ``most``."""
    left, bins, searched, out = +hist, 0, False, []
    while left:
        if not searched and left.total() <= 4 * SHARD:
            searched = True
            sizes = sorted(left.elements(), reverse=True)
            boxes = fits(sizes, cap, most - bins) if most > bins else None
            if boxes is not None:
                return out + [(1, [sizes[i] for i in b]) for b in boxes]
        top = max(left)
        rest = left - Counter({top: 1})
        one = _pattern(sorted(rest.items(), reverse=True), cap - top) + Counter({top: 1})
        times = min(left[s] // n for s, n in one.items())
        bins += times
        out.append((times, sorted(one.elements(), reverse=True)))
        left -= Counter({s: n * times for s, n in one.items()})
    return out


def containers(shards: DataFrame, items: DataFrame, decided: DataFrame) -> DataFrame:
    """(collection, container, item, size, cap): one row per item, in the containers that ``collections`` counted (``decided``).

    ``container`` is named by shard and number; those of the exact step are named ``x`` and a number, and take the items of each size in
    reading order.
    """
    kept = shards.join(decided.where("better is not null").select("collection"), "collection", "left_anti")
    boxes = kept.select("collection", "shard", "cap", F.posexplode(F.from_json("bins", "array<array<string>>")).alias("_k", "_ids"))
    rows = boxes.select("collection", F.concat_ws("-", "shard", "_k").alias("container"), "cap", F.explode("_ids").alias("item")).join(items.select("item", "size"), "item")
    groups = decided.where("better is not null").select("collection", "cap", F.posexplode("better").alias("_g", "_b"))
    filled = groups.select("collection", "cap", "_g", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_b.times"))).alias("_t"), F.col("_b.sizes").alias("_s")).select("collection", "cap", "_g", "_t", F.posexplode("_s").alias("_p", "size"))
    slot = Window.partitionBy("collection", "size").orderBy("_g", "_t", "_p")
    slots = filled.select("collection", "cap", "size", F.concat_ws("-", F.lit("x"), "_g", "_t").alias("container"), F.row_number().over(slot).alias("_r"))
    order = Window.partitionBy("collection", "size").orderBy(F.col("position").asc_nulls_first(), "item")
    mine = items.where("size between 1 and cap").join(decided.where("better is not null").select("collection"), "collection", "left_semi")
    ranked = mine.select("collection", "size", "item", F.row_number().over(order).alias("_r"))
    exact = slots.join(ranked, ["collection", "size", "_r"])
    names = ["collection", "container", "item", "size", "cap"]
    return rows.select(*names).unionByName(exact.select(*names))
