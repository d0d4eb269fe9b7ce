"""Prefix dynamic programming over byte-pair vocabularies.

The encoding of a string by merges is a chain of tokens in which every neighbouring pair is *stable*: encoding the two
tokens' joined text gives the two tokens back. So the encoding of each prefix is that of a shorter prefix and one last
token, the only one that exists and is stable behind the shorter prefix's last token. `Vocabulary.prefixes` fills this
table for many words at once: numpy arrays over all words' positions, one step for each prefix length.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: The base's inverse modulo 2 ** 64.
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longest word, in symbols, that goes through the table; longer ones are merged one by one.
LONGEST = 64
#: Pairs whose stability a worker keeps (about 100 MB), and symbols of words that go through the table at a time.
PAIRS = 1_000_000
CHUNK = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Vocabulary:
    """Tokens as tuples of symbols (whole numbers below `symbols`), with ranks and pairs that merge.

    tokens: id -> symbols. rank: id -> order in which merges happen, -1 for tokens of one symbol. merge(a, b): the token
    that a and b make, or -1. split(t): the two tokens that t was merged from.
    """

    def __init__(self, tokens: dict[int, tuple[int, ...]], rank: dict[int, float]):
        self.rank, self.tokens = rank, tokens
        self.longest = max(map(len, tokens.values()))
        self.unknown = max(tokens) + 1
        self._stable: dict[int, bool] = {}
        ids = np.fromiter(tokens, np.int64)
        flat = np.concatenate([np.array(tokens[i], np.int64) for i in ids])
        sizes = np.array([len(tokens[i]) for i in ids])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        keys = self._sums(flat)
        bits = (4 * len(ids)).bit_length()
        self._slots, self._shift = 1 << bits, _U(64 - bits)
        self._keys, self._ids = np.zeros(self._slots, _U), np.full(self._slots, -1, np.int32)
        for key, token in zip(self._key(keys, starts, sizes), ids, strict=True):
            at = int(key >> self._shift)
            while self._ids[at] >= 0:
                at = (at + 1) % self._slots
            self._keys[at], self._ids[at] = key, token

    @staticmethod
    def _sums(flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat) + 1, _U)
        np.cumsum(_mix(flat.astype(_U) + _U(1)) * _powers(_BASE, len(flat)), out=out[1:])
        return out

    @staticmethod
    def _key(sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return _mix((sums[starts + sizes] - sums[starts]) * _powers(_INVERSE, len(sums))[starts] + np.asarray(sizes).astype(_U))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self._shift).astype(np.int64)
        found, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            ids = self._ids[at[left]]
            hit = (ids >= 0) & (self._keys[at[left]] == keys[left])
            found[left[hit]] = ids[hit]
            left = left[(ids >= 0) & ~hit]
            at[left] = (at[left] + 1) % self._slots
        return found

    def merge(self, a: int, b: int) -> int:
        raise NotImplementedError

    def split(self, t: int) -> tuple[int, int]:
        raise NotImplementedError

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a into b at any moment of the two tokens' own making, undone step by step."""
        limit = float("inf")
        while True:
            joint = self.merge(a, b)
            if joint >= 0 and self.rank[joint] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.split(a)[1]
            else:  # a merge of equal rank further left comes first
                limit, b = rb + 0.5, self.split(b)[0]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, at = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)
        known, out = self._stable, np.zeros(len(pairs), bool)
        if len(known) > PAIRS:
            known.clear()
        for i, pair in enumerate(pairs.tolist()):
            ok = known.get(pair)
            if ok is None:
                x, y = pair >> 32, pair & 0xFFFFFFFF
                ok = known[pair] = x >= self.unknown or y >= self.unknown or self._is_stable(x, y)
            out[i] = ok
        return out[at]

    def prefixes(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words flat[offsets[w]:offsets[w + 1]]: (last, back) of every prefix, at flat's positions.

        last[p]: last token of the prefix that ends with symbol p; back[p]: its number of symbols. A symbol that no token
        has is the token `unknown` + symbol. Words are to be of LONGEST symbols at most.
        """
        n, sizes = len(flat), np.diff(offsets)
        last, back = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        if not n:
            return last, back
        sums, inverse = self._sums(flat), _powers(_INVERSE, n + 1)
        room = np.repeat(offsets[1:], sizes) - np.arange(n)  # symbols up to the word's end
        token = np.full((min(self.longest, int(sizes.max())), n), -1, np.int32)
        for k in range(1, len(token) + 1):
            at = np.flatnonzero(room >= k)
            token[k - 1, at] = self._find(_mix((sums[at + k] - sums[at]) * inverse[at] + _U(k)))
        token[0] = np.where(token[0] < 0, self.unknown + flat, token[0])
        order = np.argsort(-sizes, kind="stable")
        starts, longest_first = offsets[:-1][order], sizes[order]
        for i in range(1, int(sizes.max()) + 1):
            words = starts[: np.searchsorted(-longest_first, -i, side="right")]
            end = words + i - 1
            rows, cand, size = [], [], []
            for k in range(1, min(i, len(token)) + 1):
                t = token[k - 1, end - k + 1]
                if k == i:  # the whole prefix is one token; every token is its own encoding
                    hit = np.flatnonzero((t >= 0) & self._whole(t))
                    last[end[hit]], back[end[hit]] = t[hit], k
                else:
                    hit = np.flatnonzero(t >= 0)
                    rows.append(hit), cand.append(t[hit]), size.append(np.full(len(hit), k))
            if rows:
                row, cand_, size_ = np.concatenate(rows), np.concatenate(cand), np.concatenate(size)
                open_ = last[end[row]] < 0
                row, cand_, size_ = row[open_], cand_[open_], size_[open_]
                ok = self.stable(last[end[row] - size_], cand_)
                last[end[row[ok]]], back[end[row[ok]]] = cand_[ok], size_[ok]
        return last, back

    def _whole(self, t: np.ndarray) -> np.ndarray:
        return np.ones(len(t), bool)

    def counts(self, last: np.ndarray, back: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every prefix."""
        n, sizes = np.zeros(len(last), np.int64), np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        starts, longest_first = offsets[:-1][order], sizes[order]
        for i in range(1, int(sizes.max(initial=0)) + 1):
            words = starts[: np.searchsorted(-longest_first, -i, side="right")]
            end = words + i - 1
            before = end - back[end]
            n[end] = np.where(before >= words, n[np.maximum(before, 0)], 0) + 1
        return n

    def merged(self, symbols: list[int]) -> list[int]:
        """The encoding of one string by merging its best pair again and again: for words too long for the table."""
        import heapq

        one = self._one()
        toks = [one.get(s, self.unknown + s) for s in symbols]
        nxt, prv = list(range(1, len(toks) + 1)), list(range(-1, len(toks) - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(toks) and (m := self.merge(toks[i], toks[j])) >= 0:
                heapq.heappush(heap, (self.rank[m], i, toks[i], toks[j], m))

        for i in range(len(toks) - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if toks[i] != a or j >= len(toks) or toks[j] != b:
                continue
            toks[i], toks[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[j] < len(toks):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [t for t in toks if t >= 0]

    def _one(self) -> dict[int, int]:
        if not hasattr(self, "_ones"):
            self._ones = {s[0]: t for t, s in self.tokens.items() if len(s) == 1}
        return self._ones
