"""Words of many texts at once, as arrays: places, 64-bit hashes, and windows over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on together, so that arrays per byte stay small whatever a text's length.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: By byte: part of a word of any signs; part of a word of letters and digits (after lower-casing).
SIGNS = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
LETTERS = np.array([48 <= x <= 57 or 97 <= x <= 122 or x >= 128 for x in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + 4096)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (_BASE, _INVERSE)]
    return _powers


def words(data: bytes, table: np.ndarray = SIGNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of data; equal words have equal hashes, wherever they stand."""
    every = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(every):
        end = min(at + STEP, len(every))
        while end < len(every) and table[every[end - 1]]:  # a step ends outside a word
            rest = np.flatnonzero(~table[every[end : end + STEP]])
            end = end + int(rest[0]) + 1 if len(rest) else min(end + STEP, len(every))
        part = every[at:end]
        edge = np.diff(table[part].astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        out.append((s + at, e + at, mixed((total[e] - total[s]) * down[s])))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = max(0, len(h) - k + 1)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(factor)
        factor = factor * 0xA24BAED4963EE407 % (1 << 64)
    return mixed(out)


def slide(v: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w consecutive values, by doubling."""
    width = 1
    while width < w:
        step = min(width, w - width)
        v, width = best(v[:-step], v[step:]) if len(v) > step else v[:0], width + step
    return v


def batches(texts: list[bytes], size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes in all; a longer text is alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Joined:
    """Texts laid end to end, a sentinel word after each, so that windows over ``h`` that leave a text equal none.

    Words are numbered with the sentinels: text i has words first[i] to first[i + 1] - 2.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray = SIGNS):
        self.data = b"\n".join(texts) + b"\n"
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, ends, h = words(self.data, table)
        after = np.searchsorted(starts, offsets[1:])  # words before the end of each text
        self.count = np.diff(after, prepend=0)
        fence = mixed(np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(np.random.default_rng(len(self.data)).integers(1 << 62)))
        self.h = np.insert(h, after, fence)
        self.starts = np.insert(starts, after, -1)
        self.ends = np.insert(ends, after, -1)
        self.first = np.concatenate([[0], after + np.arange(1, len(texts) + 1)])
        self.fence = self.first[1:] - 1

    def text(self, a: int, b: int) -> bytes:
        """What lies from word a to word b, both included."""
        return self.data[self.starts[a] : self.ends[b]]

    def whole(self, width: int) -> np.ndarray:
        """By first word: whether ``width`` words from there stay in one text."""
        n = max(0, len(self.h) - width + 1)
        until = np.zeros(len(self.h) + 1, np.int64)
        until[self.fence + 1] = 1
        np.cumsum(until, out=until)
        return until[width : width + n] == until[:n]
