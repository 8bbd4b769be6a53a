"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Words are what lies between white space (ASCII space and tab to carriage return); A-Z are
lower-cased. A shingle is five words in a row; a text with fewer words has one shingle, its whole
word sequence. Texts are compared by these hashes: two different shingles share one with
probability 2^-64.
"""

from __future__ import annotations

import numpy as np

from bucketscore.llm.rows import mix

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Base of the polynomial hash of a word's bytes, odd and so invertible modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
#: Bytes hashed at a time; cut at white space or between texts.
_SEGMENT = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, factor, np.uint64)]))
    return _powers["up"], _powers["down"]


class Words:
    """``hashes``, ``starts`` and ``ends`` of all words; text i has ``bounds[i]:bounds[i + 1]`` of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        position, end = int(bounds[0]), int(bounds[-1])
        while position < end:
            stop = min(position + _SEGMENT, end)
            if stop < end:
                stop = self._cut(data, bounds, stop)
            found.append(self._hash(data, bounds, position, stop))
            position = stop
        self.hashes, self.starts, self.ends = (np.concatenate(column) for column in zip(*found))
        self.bounds = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.bounds)

    @staticmethod
    def _cut(data: np.ndarray, bounds: np.ndarray, stop: int) -> int:
        """The first position from ``stop`` on where a text begins or white space is."""
        limit = int(bounds[np.searchsorted(bounds, stop)])
        while stop < limit:
            spaces = np.flatnonzero(_SPACE[data[stop : min(stop + 4096, limit)]])
            if len(spaces):
                return stop + int(spaces[0])
            stop = min(stop + 4096, limit)
        return limit

    @staticmethod
    def _hash(data: np.ndarray, bounds: np.ndarray, first: int, last: int):
        part = _LOWER[data[first:last]]
        inside = ~_SPACE[part]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = bounds[np.searchsorted(bounds, first) : np.searchsorted(bounds, last)] - first
        edges = edges[edges > 0]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _tables(last - first + 1)
        running = np.zeros(last - first + 1, np.uint64)
        # Bytes count from 1, so that a zero byte is seen.
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: last - first], out=running[1:])
        value = (running[ends] - running[starts]) * down[starts]
        return mix(value ^ (ends - starts).astype(np.uint64)), starts + first, ends + first


def shingles(words: Words) -> list[np.ndarray]:
    """For each text, its different shingles in order of their hash."""
    h = words.hashes
    rolling = np.zeros(len(h), np.uint64)
    if len(h) >= WIDTH:
        total = np.zeros(len(h) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            total += h[k : len(h) - WIDTH + 1 + k] * _FACTORS[k]
        rolling[: len(total)] = mix(total)
    out = []
    for start, stop in zip(words.bounds[:-1], words.bounds[1:]):
        n = stop - start
        if n >= WIDTH:
            out.append(np.unique(rolling[start : stop - WIDTH + 1]))
        elif n:
            total = np.array([n], np.uint64)
            for k in range(n):
                total = mix(total * _BASE + h[start + k])
            out.append(total)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
