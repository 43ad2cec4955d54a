"""Suffix automaton of a reference shard: several texts, one automaton, streamed matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """Online construction over several texts; each state knows which texts end in it.

    ``links`` form the suffix tree of the reversed texts: the texts that contain a state's strings are
    those of its whole subtree.
    """

    def __init__(self, texts: list[str]):
        self.to: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: dict[int, set[int]] = {}
        for n, t in enumerate(texts):
            last = 0
            for c in t:
                last = self._extend(last, c)
                self.ends.setdefault(last, set()).add(n)
        self.below: dict[int, list[int]] = {}
        for s in range(1, len(self.link)):
            self.below.setdefault(self.link[s], []).append(s)
        self._texts: dict[int, frozenset[int]] = {}

    def _clone(self, p: int, q: int, c: str) -> int:
        k = len(self.len)
        self.to.append(self.to[q].copy())
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = k
        while p >= 0 and self.to[p].get(c) == q:
            self.to[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, last: int, c: str) -> int:
        q = self.to[last].get(c)
        if q is not None:  # another text has been here
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        k = len(self.len)
        self.to.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.to[p]:
            self.to[p][c] = k
            p = self.link[p]
        if p >= 0:
            q = self.to[p][c]
            self.link[k] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return k

    def texts_of(self, state: int) -> frozenset[int]:
        """Numbers of all texts that contain the state's strings."""
        if state not in self._texts:
            out: set[int] = set()
            stack = [state]
            while stack:
                s = stack.pop()
                out |= self.ends.get(s, set())
                stack.extend(self.below.get(s, ()))
            self._texts[state] = frozenset(out)
        return self._texts[state]

    def stream(self, text: str, least: int):
        """Yield (end, length, state) wherever the longest match that ends there has at least ``least`` characters.

        ``state`` is the one of the suffix of ``least`` characters, so its texts are all that share that much.
        """
        s = n = 0
        for i, c in enumerate(text):
            while s and c not in self.to[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.to[s]:
                s, n = self.to[s][c], n + 1
            else:
                s = n = 0
            if n >= least:
                a = s
                while self.len[self.link[a]] >= least:
                    a = self.link[a]
                yield i + 1, n, a
