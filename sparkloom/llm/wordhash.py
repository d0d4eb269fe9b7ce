"""Hashes of words and of word ranges for many texts at once, by numpy over the texts' bytes.

A word is a run of bytes other than the six ASCII white-space bytes. Its hash is a polynomial over random values of its
bytes; the hash of a range of words is a polynomial over its words' hashes. Both come from running sums, so any range's
hash is one subtraction and one product. Each hash has two independent 64-bit halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = [mix(np.arange(1, 257, dtype=_U) * _U(b)) for b in _BASES]
#: Powers that a worker keeps; longer tables are made for one call. Bytes of text that are hashed at a time.
KEPT = 1 << 18
SLICE = 1 << 18
_kept: list[list[tuple[np.ndarray, np.ndarray]]] = []


def _made(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for b in _BASES:
        pair = []
        for x in (b, pow(b, -1, 1 << 64)):
            p = np.full(n, x, _U)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        out.append((pair[0], pair[1]))
    return out


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, n of each at least."""
    if n > KEPT + 1:
        return _made(n)
    if not _kept:
        _kept.append(_made(KEPT + 1))
    return _kept[0]


class Sums:
    """Range hashes over an array of 64-bit values, one for each half."""

    def __init__(self, values: list[np.ndarray]):
        n = len(values[0])
        self.powers = _powers(n + 1)
        self.sums = []
        for v, (up, _) in zip(values, self.powers, strict=True):
            s = np.zeros(n + 1, _U)
            np.cumsum(v * up[:n], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
        s = self.sums[half]
        return mix((s[end] - s[start]) * self.powers[half][1][start] + (end - start).astype(_U))


def _slices(gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end behind a gap, or where the bytes end: no word lies in two of them."""
    at = 0
    while at < len(gap):
        to = min(at + SLICE, len(gap))
        while to < len(gap) and not gap[to - 1]:
            ahead = np.flatnonzero(gap[to : to + SLICE])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(to + SLICE, len(gap))
        yield at, to
        at = to


class Words:
    """The words of some texts: first[d]..first[d + 1] are document d's; hashes has both halves; sums their range hashes.

    starts: sizes of words' beginnings that are hashed too. Bytes are hashed slice by slice; what stays is by word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, starts: tuple[int, ...] = ()):
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        gap = _SPACE[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        del before, after
        self.hashes = [np.zeros(len(start), _U) for _ in _BASES]
        begun: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in starts}
        for at, to in _slices(gap):
            own = slice(*map(int, np.searchsorted(start, (at, to))))
            part = _LOWER[raw[at:to]] if lower else raw[at:to]
            letters, s, e = Sums([t[part] for t in _BYTES]), start[own] - at, end[own] - at
            for half in (0, 1):
                self.hashes[half][own] = letters.of(s, e, half)
            for n in starts:
                long = np.flatnonzero(e - s >= n)
                begun[n].append((long + own.start, letters.of(s[long], s[long] + n, 0)))
        none = (np.zeros(0, np.int64), np.zeros(0, _U))
        self.begun = {n: (np.concatenate([none[0], *[x for x, _ in found]]), np.concatenate([none[1], *[x for _, x in found]])) for n, found in begun.items()}
        self.first = np.searchsorted(start, offsets)
        self.sums = Sums(self.hashes)

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first bytes of the words that have so many; size is one of `starts`."""
        return self.begun[size]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of each document's hash."""
        return self.sums.of(self.first[:-1], self.first[1:], 0), self.sums.of(self.first[:-1], self.first[1:], 1)


def pieces(batch: pa.RecordBatch, column: str | int, size: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of so many bytes of text at most, or of one row; with the slice's texts."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1].astype(np.int64)
    begun = int(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, begun + size, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        begun, at = int(ends[to - 1]), to


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64), pa.int64())
