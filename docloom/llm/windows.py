"""Vectorised hashes of all windows of a text, shared by the span operators."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values; the input stays as it is."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd multipliers for short windows, one per place, spread by the finalizer so that none is a small multiple of another.
with np.errstate(over="ignore"):
    _PLACES = mix(np.arange(1, 9, dtype=np.uint64) * _BASE) | np.uint64(1)


def window_hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` characters, by doubling: h(2w, i) = f(h(w, i), h(w, i+w)).

    Works for any width from its binary digits; equal windows hash alike wherever they stand.
    """
    n = len(chars) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if width <= len(_PLACES):  # a weighted sum is cheaper than doubling
            wide = chars.astype(np.uint64) + np.uint64(1)
            out = wide[:n] * _PLACES[0]
            for i in range(1, width):
                out += wide[i : i + n] * _PLACES[i]
            return mix(out)
        power = mix((chars.astype(np.uint64) + np.uint64(1)) * _BASE)
        out, done, w = None, 0, 1
        left = width
        while left:
            if left & 1:
                part = power[done : done + n]
                out = part if out is None else mix(out * _BASE + part)
                done += w
            left >>= 1
            if left:
                power = mix(power[: len(power) - w] * _BASE + power[w:]) if len(power) > w else power[:0]
                w *= 2
        return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct positions that hold the (last) smallest value of some ``width`` consecutive values."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    # the low bits carry the position, so that equal values resolve to the last one
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h & ~((np.uint64(1) << bits) - np.uint64(1))) | (np.uint64(n) - np.arange(n, dtype=np.uint64) - np.uint64(1))
    pad = (-n) % width
    full = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (n - 1 - (np.unique(low) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
