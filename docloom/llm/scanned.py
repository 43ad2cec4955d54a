"""Noise in text from scanned pages: a language model and a noise channel learnt from the tables themselves.

Running lines and page numbers are found per document. Documents without such lines and without broken
words are taken as clean; their words, word pairs that could be one word, compounds with a hyphen, marks in
context and ideographs form the model. A noisy text is de-lined and decoded jointly: the cheapest way to read
its characters as known words, where a word may be split, merged with its neighbour, broken by a hyphen at a
line end, misread by the usual confusions, or off by one lost or stray character. Known words in
known surroundings are fixed points, so only the stretches between them are searched.
"""

from __future__ import annotations

import math
import re

import numpy as np

#: Shapes that scanners confuse, as (seen, meant).
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("c", "e"), ("e", "c"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"),
    ("y", "v"), ("v", "y"), ("u", "ii"), ("ii", "u"), ("n", "ri"), ("ri", "n"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("li", "h"), ("l", "i"), ("i", "l"), ("l", "1"), ("o", "0"), ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"),
]
BREAK = "-\xad¬‐‑"
WORD = re.compile(r"[^\W_一-鿿]+")
HAN = re.compile(r"[一-鿿]")
PIECE = re.compile(r"[^\W_一-鿿]+|[一-鿿]|[^\w]+|_+")
COMPOUND = re.compile(r"[^\W\d_一-鿿]{2,}-[^\W\d_一-鿿]{2,}")
BROKEN = re.compile(rf"([^\W\d_一-鿿]+)[{BREAK}][ \t]*$")
CONTINUES = re.compile(r"[ \t]*([^\W\d_一-鿿]+)")
EXPECTED = 12.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâçèêëîïôûùœ"


def delined(lines: list[str], model: "Model") -> tuple[str, str]:
    """(lines put on one, fragment). A word broken by a hyphen is joined; other lines meet at a blank, those of mostly
    ideographic text, which is cut anywhere, without one. What a hyphen at the very end leaves of a word is the fragment."""
    fragment = ""
    whole = "".join(lines)
    dense = len(HAN.findall(whole)) > 0.25 * max(1, len(whole))
    out = ""
    for i, line in enumerate(lines):
        last = i + 1 == len(lines)
        end = line.rstrip()
        m = broken(end)
        if m and last:
            out += end[: m.start(1)].rstrip()
            fragment = m.group(1)
        elif m and (n := CONTINUES.match(lines[i + 1])):
            keep = end[-1] in "-‐‑" and _compound(m.group(1).lower(), n.group(1).lower(), model)
            out += end[:-1] + ("-" if keep else "")
        elif dense:
            out += line
        else:
            out += end + ("" if last else " ")
        if not last and not dense:
            lines = [*lines[: i + 1], lines[i + 1].lstrip(), *lines[i + 2 :]]
    return out.strip(), fragment


class _Shapes(dict):
    """Class of a character by its code point, for ``str.translate``; filled as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = self[code] = "H" if "一" <= c <= "鿿" else " " if c.isspace() else "0" if re.match(r"\d", c) else "a" if re.match(r"[^\W_]", c) else c
        return got


_SHAPES = _Shapes()


def shapes(text: str) -> str:
    """The class of every character: letter a, digit 0, ideograph H, blank, or the mark itself."""
    return text.translate(_SHAPES)


_MARKS = re.compile(r"[^a0H ]+|  +|(?<=H) (?=H)")


def broken(line: str) -> re.Match | None:
    """The word that a hyphen breaks at the end of a line (without white space behind it)."""
    return BROKEN.search(line) if line and line[-1] in BREAK else None


def marks(text: str):
    """Runs of marks with the classes around them. Double blanks, and blanks between ideographs, are marks too."""
    s = shapes(text)
    for m in _MARKS.finditer(s):
        a, z = m.span()
        run = m.group()
        yield (s[a - 1] if a else "^") + (run if run[0] != " " else run[:2]) + (s[z] if z < len(s) else "$")


_UNDONE = [(b, a) for a, b in CONFUSED[:24]]


def _confused(w: str, pairs: list[tuple[str, str]]):
    """The word with one confusion, at each place."""
    for a, b in pairs:
        i = w.find(a)
        while i >= 0:
            yield w[:i] + b + w[i + len(a) :]
            i = w.find(a, i + 1)


class Model:
    """What clean text looks like. ``words`` maps a lower-case word to its count."""

    def __init__(self, words: dict[str, int], pairs: set[str], compounds: set[str], contexts: set[str], han: dict[str, int], han_pairs: dict[str, int], odd: dict[str, int] | None = None):
        self.words, self.pairs, self.compounds, self.contexts, self.han, self.han_pairs = words, pairs, compounds, contexts, han, han_pairs  # counts of words, ideographs and their pairs
        self.total = max(1, sum(words.values()))
        self.han_total = max(1, sum(han.values()))
        self.parts = {c.split("-")[0] for c in compounds}
        self.lefts = {c[:-1] for c in contexts}
        self.rights = {c[1:] for c in contexts}
        self.mark_chars = {x for c in contexts for x in c[1:-1]}
        self.odd = odd or {}  # words that only noisy documents have, with their counts
        self.seen: dict[str, tuple[float, str] | None] = {}
        self._index = self._around = None
        self.longest = max(map(len, words), default=0)

    def cost(self, w: str) -> float:
        """-log P of a known word; all numbers are known and equally rare."""
        return math.log(self.total / self.words[w]) if w in self.words else math.log(self.total + 1)

    def known(self, w: str) -> bool:
        return w in self.words or w.isdigit()

    def stray(self, context: str) -> bool:
        """A mark that clean text never shows in these surroundings; at the edge of a text one side must do."""
        if context[0] == "^":
            return context[-1] != "$" and context[1:] not in self.rights
        return context[:-1] not in self.lefts if context[-1] == "$" else context not in self.contexts

    def clean_mark(self, p: str) -> str:
        """A run of marks without the characters that clean text has in no mark at all; blanks left over are merged."""
        chars = self.mark_chars
        kept = "".join(c for c in p if c.isspace() or c in chars)
        return p if kept == p else (" " if kept.isspace() else kept.replace("  ", " "))

    @property
    def index(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(keys, numbers, words): hashes of the known words with one letter left out, or one confusion undone, and the words they
        belong to, in order of the keys. Built once per process; a word has some twenty entries of twelve bytes."""
        if self._index is None:
            words = [w for w in self.words if len(w) > 1]
            keys: list[int] = []
            numbers: list[int] = []
            for n, w in enumerate(words):
                own = {hash(w[:i] + "*" + w[i + 1 :]) for i in range(len(w))} | {hash(x) for x in _confused(w, _UNDONE)}
                keys.extend(own)
                numbers.extend([n] * len(own))
            order = np.argsort(np.array(keys, np.int64), kind="stable")
            self._index = (np.array(keys, np.int64)[order], np.array(numbers, np.int32)[order], words)
        return self._index

    def _met(self, texts: list[str]) -> set[str]:
        """Known words that have an entry like one of the texts."""
        keys, numbers, words = self.index
        at = np.array([hash(t) for t in texts], np.int64)
        low, high = np.searchsorted(keys, at, "left"), np.searchsorted(keys, at, "right")
        return {words[numbers[i]] for a, z in zip(low.tolist(), high.tolist()) if a < z for i in range(a, z)}

    def variants(self, w: str):
        """(cost, reading) of one misread word: one or two confusions, else one lost, stray or changed letter. Readings are known.

        Readings two steps away are looked up from both sides: what one step makes of the word, against what
        one step back makes of the known words.
        """
        one = set(_confused(w, CONFUSED))
        for v in one:
            if self.known(v):
                yield 3.0, v
        if one:
            for v in self._met(list(one)):
                if any(x in one for x in _confused(v, _UNDONE)):
                    yield 6.0, v
        if len(w) >= 4:
            for i in range(len(w)):
                if self.known(v := w[:i] + w[i + 1 :]):
                    yield 5.0, v
            for v in self._met([w[:i] + "*" + w[i + 1 :] for i in range(len(w))]):
                i = next((i for i, (x, y) in enumerate(zip(w, v)) if x != y), -1)
                if len(v) == len(w) and i >= 0 and v[i] in ALPHABET and v[i + 1 :] == w[i + 1 :]:
                    yield 6.0, v
            for v in self._met([w[:i] + "*" + w[i:] for i in range(len(w) + 1)]):
                i = next((i for i, (x, y) in enumerate(zip(w, v)) if x != y), len(w))
                if len(v) == len(w) + 1 and v[i] in ALPHABET and v[i + 1 :] == w[i:]:
                    yield 5.0, v

    def word(self, w: str) -> tuple[float, str] | None:
        """Cheapest reading of a run of letters as one word (cost above the word's own, reading), else None; of equals the first by letters."""
        if self.known(w):
            return 0.0, w
        if len(w) > max(self.longest, 2) + 2 and w.isalpha():  # two steps take a letter each at most; letters alone never become a number
            return None
        if w not in self.seen:
            best = min(((c + self.cost(v), v) for c, v in self.variants(w) if len(v) > 1), default=None)
            # a form nearly as frequent as what it would be read as is a word of its own
            if best is not None and self.odd.get(w, 0) * (20 if best[0] - self.cost(best[1]) <= 3.0 else 50) > self.words.get(best[1], 0):
                best = None
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = None if best is None else (best[0] - self.cost(best[1]), best[1])
        return self.seen.get(w)

    @property
    def around(self) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
        """(followers, predecessors) of each ideograph in clean text."""
        if self._around is None:
            after: dict[str, set[str]] = {}
            before: dict[str, set[str]] = {}
            for a, b in self.han_pairs:
                after.setdefault(a, set()).add(b)
                before.setdefault(b, set()).add(a)
            self._around = after, before
        return self._around

    def merged(self, w: str) -> list[str] | None:
        """Two known words that lost the blank between them."""
        best = None
        for i in range(1, len(w)):
            a, b = w[:i], w[i:]
            if a in self.words and b in self.words:
                c = self.cost(a) + self.cost(b)
                if best is None or c < best[0]:
                    best = (c, [a, b])
        if best is None and len(w) >= 8:
            for i in range(3, len(w) - 2):
                a, b = w[:i], w[i:]
                if (a in self.words) != (b in self.words):
                    x, y = self.word(a), self.word(b)
                    if x and y and x[0] + y[0] <= 3.0:
                        return [x[1], y[1]]
        return best[1] if best else None

    def decode(self, run: list[str]) -> tuple[list[str], bool]:
        """Read neighbouring runs of letters (blanks between them) as words; True when that needs a correction.

        Dynamic programming over the runs: each word spans one to three of them (splits), or one run holds two words
        (merge); costs are -log P of the words plus those of the corrections.
        """
        n = len(run)
        best: list[tuple[float, int, list[str], bool]] = [(0.0, 0, [], False)] + [(math.inf, 0, [], False)] * n
        for i in range(n):
            base = best[i][0]
            if base == math.inf:
                continue
            w = run[i]
            options = []
            got = self.word(w)
            if got:
                options.append((1, got[0] + self.cost(got[1]), [got[1]], got[0] > 0))
            else:
                two = self.merged(w)
                if two:
                    options.append((1, 4.0 + sum(self.cost(x) for x in two), two, True))
            for k in (2, 3):
                if i + k <= n:
                    whole = "".join(run[i : i + k])
                    if all(x in self.words for x in run[i : i + k]) and (k > 2 or run[i] + " " + run[i + 1] in self.pairs):
                        continue
                    got = self.word(whole)
                    if got and (got[0] == 0 or len(whole) >= 6):
                        options.append((k, got[0] + self.cost(got[1]) + 4.0 * (k - 1), [got[1]], True))
            if not options or not got:
                options.append((1, 14.0 + 2.5 * len(w), [w], False))
            for k, c, words, fixed in options:
                if base + c < best[i + k][0]:
                    best[i + k] = (base + c, i, words, fixed)
        out, fixed, i = [], False, n
        while i:
            _, before, words, f = best[i]
            out[:0], fixed, i = words, fixed or f, before
        return out, fixed


CODE = re.compile(r"^[A-Z]{1,3}$|^[A-Z]\d{1,3}$")


def broken_words(lines: list[str], model: Model, at_end: bool = True) -> list[tuple[int, str]]:
    """(line, whole word) of words broken by a hyphen at a line end, or at the end of the block (whole word unknown there: '')."""
    out = []
    for i, line in enumerate(lines):
        m = broken(line.rstrip())
        if not m:
            continue
        a = m.group(1).lower()
        mark = line.rstrip()[-1]
        if i + 1 < len(lines):
            n = CONTINUES.match(lines[i + 1])
            if not n:
                continue
            b = n.group(1).lower()
            if mark in "-‐‑" and _compound(a, b, model):
                continue
            out.append((i, a + b))
        elif at_end and not (mark in "-‐‑" and a in model.parts):
            out.append((i, ""))
    return out


def _compound(a: str, b: str, model: Model) -> bool:
    """A word that is written with a hyphen: known as such, and the joined form is no word. Each half may be misread."""
    if a + "-" + b in model.compounds:
        return a + b not in model.words
    x, y = model.word(a), model.word(b)
    return bool(x and y and x[1] + "-" + y[1] in model.compounds and not (model.word(a + b) or (9,))[0] == 0)


def misread(text: str, model: Model) -> tuple[bool, str]:
    """(has misread, lost or stray characters or wrong word spacing, repaired text) of a de-lined text.

    A first word in lower case may be the rest of a word broken in the block before: it counts as misread only
    by a plain confusion. Unknown words that no correction explains are taken as names.
    """
    bad = any(model.stray(c) for c in marks(text))
    pieces = PIECE.findall(text)
    out: list[str] = []
    i = 0
    while i < len(pieces):
        p = pieces[i]
        if HAN.match(p):
            j = i
            while j < len(pieces) and HAN.match(pieces[j]):
                j += 1
            run = "".join(pieces[i:j])
            flag, run = han_run(run, model)
            bad, i = flag or bad, j
            out.append(run)
            continue
        if not WORD.match(p):
            out.append(model.clean_mark(p))
            i += 1
            continue
        j = i + 1  # the run of words with single blanks between
        while j + 1 < len(pieces) and pieces[j] == " " and WORD.match(pieces[j + 1]):
            j += 2
        words = pieces[i:j:2]
        low = [w.lower() for w in words]
        odd = [not (w in model.words or w.isdigit() or CODE.match(v)) for w, v in zip(low, words)]
        for k in range(len(low) - 1):  # two words that look like one, split
            if low[k] + low[k + 1] in model.words and low[k] + " " + low[k + 1] not in model.pairs:
                odd[k] = odd[k + 1] = True
        if True not in odd:
            out.append("".join(pieces[i:j]))
            i = j
            continue
        if i == 0 and odd[0] and words[0].islower():
            got = model.word(low[0])
            odd[0] = bool(got and got[0] <= 3.0)
        res, k = [], 0
        while k < len(words):
            if not odd[k]:
                res.append(words[k])
                k += 1
                continue
            a = k
            while k < len(words) and odd[k]:
                k += 1
            b = a - 1 if a and not words[a - 1].isdigit() and len(res) and res[-1] == words[a - 1] else a
            z = k + 1 if k < len(words) and not words[k].isdigit() else k
            del res[len(res) - (a - b) :]
            got, flag = model.decode(low[b:z])
            bad = bad or flag
            res.extend(_recased(got, words[b:z]) if flag else words[b:z])
            k = z
        out.append(" ".join(res))
        i = j
    return bad, "".join(out)


def _recased(words: list[str], seen: list[str]) -> list[str]:
    """Give repaired words the case of what stood there: each takes that of the run at its place."""
    out, letters = [], "".join(seen)
    at = 0
    for w in words:
        head = letters[at : at + 1]
        upper = letters[at : at + len(w)]
        out.append(w.upper() if len(upper) > 1 and upper.isupper() else w.capitalize() if head.isupper() else w)
        at += len(w)
    return out


def han_run(run: str, model: Model) -> tuple[bool, str]:
    """(misread, repaired run). Ideographs that clean text does not have are misread. Neighbours that it never shows, though chance alone
    would have put them together EXPECTED times, are misread, lost or stray ones.

    From left to right, the cheapest of three repairs whose neighbours clean text knows: another ideograph in place of the one at fault,
    one more between two, or one less. Of several ideographs the likeliest between its neighbours; where none fits, the run stays.
    """
    odd = lambda a, b: a not in model.han or b not in model.han or (a + b not in model.han_pairs and model.han[a] * model.han[b] > EXPECTED * model.han_total)
    if not (any(c not in model.han for c in run) or any(odd(a, b) for a, b in zip(run, run[1:]))):
        return False, run
    after, before = model.around

    def price(a: str, x: str, b: str) -> float:
        """-log P of an ideograph between two, by what follows what; at an edge by how often it stands at all."""
        left = model.han[a] / model.han_pairs[a + x] if a else model.han_total / model.han[x]
        return math.log(left) + (math.log(model.han[x] / model.han_pairs[x + b]) if b else 0.0)

    out, rest = "", run
    while rest:
        c, nxt, past, last = rest[0], rest[1:2], rest[2:3], out[-1:]
        if c in model.han and (not nxt or not odd(c, nxt)) and (not last or not odd(last, c)):
            out, rest = out + c, rest[1:]
            continue
        options: list[tuple[float, str, str]] = []
        if nxt and c in model.han:  # the next one is at fault, or one is missing before it
            swap = after.get(c, set()) & before.get(past, set()) if past else after.get(c, set())
            options += [(6.0 + price(c, x, past), c + x, rest[2:]) for x in swap]
            options += [(8.0 + price(c, x, nxt), c + x, rest[1:]) for x in after.get(c, set()) & before.get(nxt, set())]
            if past and c + past in model.han_pairs:
                options.append((8.0 + price(c, past, ""), c, rest[2:]))
        if c not in model.han or (last and odd(last, c)):  # this one is
            swap = after.get(last, set()) & before.get(nxt, set()) if last and nxt else after.get(last, set()) if last else before.get(nxt, set()) if nxt else set()
            options += [(6.0 + price(last, x, nxt), x, rest[1:]) for x in swap]
            if last and last + nxt in model.han_pairs:
                options.append((8.0 + price(last, nxt, ""), "", rest[1:]))
        if not options:
            out, rest = out + c, rest[1:]
            continue
        _, put, rest = min(options)
        out += put
    return True, out
