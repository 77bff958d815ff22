"""Vectorised text primitives on UTF-8 bytes: words, 64-bit hashes, shingles and hash lookup."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_PINV = U(pow(int(_P), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * _STEP)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, kept between blocks."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they lie."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * _STEP)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, at)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than `width`: all of them are one shingle; none: empty."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), U)
    for j in range(width):
        rolled = rolled * _P + hashes[j : n - width + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled + U(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            x = U(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    x = x * _P + h
                out.append(mix(np.array([x + U(b - a)])))
        else:
            out.append(np.zeros(0, U))
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged groups of these sizes: the group of each element and its place in the group."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]]; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashIndex:
    """Open addressing over distinct uint64 keys: find() gives each query's position in `keys`, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, U)
        self.bits = max(4, int(2 * len(self.keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self._insert(np.arange(len(self.keys)))

    def _home(self, q: np.ndarray) -> np.ndarray:
        return ((q * _STEP) >> U(64 - self.bits)).astype(np.int64)

    def _insert(self, todo: np.ndarray) -> None:
        pos = self._home(self.keys[todo])
        while len(todo):
            free = self.slot[pos] < 0
            self.slot[pos[free]] = todo[free]
            lost = self.slot[pos] != todo
            todo, pos = todo[lost], (pos[lost] + 1) & (len(self.slot) - 1)

    def add(self, keys: np.ndarray) -> None:
        """Append keys that are not in the index; positions of the old keys stay."""
        old = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.slot):
            self.bits = int(4 * len(self.keys)).bit_length()
            self.slot = np.full(1 << self.bits, -1, np.int32)
            old = 0
        self._insert(np.arange(old, len(self.keys)))

    def find(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int64)
        if not len(self.keys) or not len(q):
            return out
        todo, pos = np.arange(len(q)), self._home(q)
        got = self.slot[pos]
        hit = got >= 0
        while True:
            todo, pos, got = todo[hit], pos[hit], got[hit]
            if not len(todo):
                return out
            same = self.keys[got] == q[todo]
            out[todo[same]] = got[same]
            todo, pos = todo[~same], (pos[~same] + 1) & (len(self.slot) - 1)
            got = self.slot[pos]
            hit = got >= 0
