"""Exact byte-level BPE ids in bulk: pieces are cut with numpy, each distinct piece is encoded once and remembered.

Texts whose characters all lie below U+0250 and which hold no special token take the fast way; the library's own
encoder takes every other text, so ids are the same either way.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .textnum import HashIndex, span_hashes, spread

FAST = 0x250


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, keep: int = 1_000_000):
        """path: a tokenizers JSON file. keep: pieces remembered before the memory is emptied and filled anew."""
        self.full = Tokenizer.from_file(path)
        spec = json.load(open(path))
        back = byte_alphabet()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.piece = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [s.encode() for s in special]
        self.keep = keep
        kinds = np.zeros(FAST, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space
        for i in range(FAST):
            c = chr(i)
            kinds[i] = 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 if regex.match(r"\s", c) else 0
        kinds[0x1C:0x20] = 0  # separators that only Python calls white space
        self.kinds = kinds
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex(np.zeros(0, np.uint64))
        self.length = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def cut(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start, among the code points of texts that start at `first`."""
        n = len(points)
        kind = self.kinds[points]
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        edge[n] = True
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
        start = change.copy()
        space = kind == 3
        last_space = np.zeros(n, bool)  # white space before something else of the same text
        last_space[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        start |= last_space  # the last white space of a run stands apart,
        joined = np.zeros(n, bool)
        joined[1:] = last_space[:-1] & (points[:-1] == 32)
        start &= ~joined  # and a plain space joins what follows
        for i in np.flatnonzero((points == 39) & change & ~joined).tolist():
            two = "".join(map(chr, points[i + 1 : i + 3]))
            stop = int(np.searchsorted(first, i, "right"))
            room = (int(first[stop]) if stop < len(first) else n) - i - 1
            size = 1 if two[:1] in "stmd" and two else 2 if two in ("re", "ve", "ll") else 0
            if 0 < size <= room:
                start[i + 1 : i + 1 + size] = False
                if i + 1 + size < n:
                    start[i + 1 + size] |= size < room
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and the first id of each text (one more than texts)."""
        texts = len(at) - 1
        high = np.r_[0, np.cumsum(data >= 0xCA)]  # lead bytes of U+0280 on, and no continuation byte
        slow = (high[at[1:]] - high[at[:-1]]) > 0
        big = np.r_[0, np.cumsum((data[:-1] == 0xC9) & (data[1:] >= 0x90))] if len(data) > 1 else np.zeros(1, int)
        big = np.r_[big, big[-1:]] if len(big) == len(data) else big
        slow |= (big[np.minimum(at[1:], len(big) - 1)] - big[np.minimum(at[:-1], len(big) - 1)]) > 0
        raw = data.tobytes()
        for s in self.special:
            here = raw.find(s)
            while here >= 0:
                slow[np.searchsorted(at, here, "right") - 1] = True
                here = raw.find(s, here + 1)
        quick = np.flatnonzero(~slow)
        ids, count = [], np.zeros(texts, np.int64)
        if len(quick):
            if len(quick) < texts:
                group, place = spread(np.diff(at)[quick])
                part = data[at[quick][group] + place]
                part_at = np.r_[0, np.cumsum(np.diff(at)[quick])]
            else:
                part, part_at = data, at
            got, sizes = self._quick(part, part_at)
            count[quick] = sizes
            ids.append(got)
        if slow.any():
            own = [raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(slow)]
            got = [np.array(e.ids, np.int32) for e in self.full.encode_batch(own, add_special_tokens=False)]
            count[slow] = [len(x) for x in got]
            merged = np.zeros(count.sum(), np.int32)
            owner = np.repeat(np.arange(texts), count)
            merged[slow[owner]] = np.concatenate(got)
            if ids:
                merged[~slow[owner]] = ids[0]
            ids = [merged]
        return ids[0] if ids else np.zeros(0, np.int32), np.r_[0, np.cumsum(count)]

    def _quick(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = data[lead].astype(np.int32)
        wide = np.flatnonzero(points >= 0xC0)
        points[wide] = ((points[wide] & 0x1F) << 6) | (data[lead[wide] + 1] & 0x3F)
        first = np.searchsorted(lead, at)
        start = self.cut(points, first[:-1][np.diff(first) > 0])
        a = lead[start]
        b = np.r_[a[1:], len(data)]
        h = span_hashes(data, a, b)
        row = self.index.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            if len(self.index.keys) > self.keep:
                self.forget()
                row[:] = -1
                new = np.arange(len(h))
            keys, pick = np.unique(h[new], return_index=True)
            pick = new[pick]
            raw = data.tobytes()
            got = [self.piece(raw[x:y].decode()) for x, y in zip(a[pick].tolist(), b[pick].tolist(), strict=True)]
            size = np.array([len(g) for g in got], np.int32)
            self.begin = np.r_[self.begin, len(self.store) + np.cumsum(size) - size]
            self.length = np.r_[self.length, size]
            self.store = np.r_[self.store, np.array([i for g in got for i in g], np.int32)]
            self.index.add(keys)
            row[new] = self.index.find(h[new])
        size = self.length[row]
        group, place = spread(size)
        ids = self.store[self.begin[row][group] + place]
        total = np.r_[0, np.cumsum(size)]
        piece_at = np.searchsorted(start, first)
        return ids, np.diff(total[piece_at])
