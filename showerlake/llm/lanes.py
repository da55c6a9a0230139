"""The prefix tables of many short pre-tokens side by side, in numpy.

Lane i holds one pre-token. Prefix by prefix, for all lanes at once, the candidates for the last token are
looked up by a rolling hash and the one that fits its predecessor stays. Encodings are compared with
their bytes at the end, so a clash of hashes cannot pass.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers for the rolling hash and for hash slots.
P = np.uint64(0x9E3779B97F4A7C15)
K = np.uint64(0xD6E8FEB86659FD93)
SLOT_BITS, PAIR_BITS = 20, 21
#: Longest pre-token in bytes that gets a lane.
WIDEST = 40


class HashClash(ValueError):
    """Two byte strings share a 64-bit hash; the words of the pass must be encoded without lanes."""


class Lanes:
    def __init__(self, vocabulary):
        v = self.vocabulary = vocabulary
        n = len(v.bytes_of)
        self.power = np.ones(max(v.longest, WIDEST) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(self.power) - 1, P), out=self.power[1:])
        self.size = np.array(v.sizes, np.int64)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.sound = np.zeros(n, bool)
        self.hash = np.zeros(n, np.uint64)
        for t in range(n):
            if (parts := v.split(t)) is not None:
                self.left[t], self.right[t] = parts
            self.sound[t] = v.sound(t)
            h = 0
            for byte in v.bytes_of[t]:
                h = (h * int(P) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            self.hash[t] = h
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.reach = 1
        for t, slot in enumerate(self._slot(self.hash).tolist()):
            step = 0
            while self.slots[(slot + step) & ((1 << SLOT_BITS) - 1)] >= 0:
                step += 1
            self.slots[(slot + step) & ((1 << SLOT_BITS) - 1)] = t
            self.reach = max(self.reach, step + 1)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # direct-mapped: pair * 2 + fits

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * K) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def token(self, h: np.ndarray) -> np.ndarray:
        """Id of the token with this hash, or -1."""
        slot = self._slot(h)
        found = self.slots[slot]
        miss = np.flatnonzero((found >= 0) & (self.hash[found] != h))
        for step in range(1, self.reach):
            if not len(miss):
                break
            found[miss] = t = self.slots[(slot[miss] + step) & ((1 << SLOT_BITS) - 1)]
            miss = miss[(t >= 0) & (self.hash[t] != h[miss])]
        if len(miss):
            found[miss] = -1
        return found

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vocabulary.fit for many pairs, with a direct-mapped table of recent answers."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.astype(np.uint64) * K) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            out[new] = ok = self._fit(left[new].astype(np.int32), right[new].astype(np.int32))
            self.pairs[slot[new]] = key[new] << 1 | ok
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), len(self.size), np.int64)
        while len(at):
            rank = self.token(self.hash[a] * self.power[np.minimum(self.size[b], len(self.power) - 1)] + self.hash[b])
            bad = (rank >= 0) & (rank < until)
            ok[at[bad]] = False
            in_a, in_b = self.right[a], self.left[b]
            go = ~bad & ((in_a >= 0) | (in_b >= 0))
            a, b, at, in_a, in_b = a[go], b[go], at[go], in_a[go], in_b[go]
            back_a = (in_b < 0) | ((in_a >= 0) & (a > b))
            until = np.where(back_a, a, b + 1).astype(np.int64)
            a, b = np.where(back_a, in_a, a), np.where(back_a, b, in_b)
        return ok

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word of 1 to WIDEST bytes."""
        sizes = np.array(list(map(len, words)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        n, widest = len(words), int(sizes.max(initial=0))
        ordered = [words[i] for i in order.tolist()]
        raw = np.frombuffer(b"".join([w.ljust(widest, b"\0") for w in ordered]), np.uint8).reshape(n, widest).T.astype(np.uint64)
        lengths = sizes[order]
        prefix = np.zeros((widest + 1, n), np.uint64)
        last = np.full((widest + 1, n), -1, np.int32)
        for end in range(1, widest + 1):
            m = int(np.searchsorted(-lengths, -end, side="right"))  # lanes at least this long
            prefix[end, :m] = prefix[end - 1, :m] * P + raw[end - 1, :m] + np.uint64(1)
            open_ = np.arange(m)
            for start in range(max(0, end - self.vocabulary.longest), end):
                if not len(open_):
                    break
                t = self.token(prefix[end, open_] - prefix[start, open_] * self.power[end - start])
                good = (t >= 0) & self.sound[t]
                if start and good.any():
                    some = np.flatnonzero(good)
                    good[some] = self.fit(last[start, open_[some]], t[some])
                last[end, open_[good]] = t[good]
                open_ = open_[~good]
            if len(open_):
                raise HashClash("a byte has no token")
        out: list = [None] * n
        end, steps, lanes = lengths.copy(), [], np.arange(n)
        while len(lanes):
            t = last[end[lanes], lanes]
            steps.append((lanes, t))
            end[lanes] -= self.size[t]
            lanes = lanes[end[lanes] > 0]
        lane = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, np.int32)
        by = np.argsort(lane[::-1], kind="stable")  # steps come last token first
        ids, lane = ids[::-1][by].tolist(), lane[::-1][by]
        cuts = np.searchsorted(lane, np.arange(n + 1)).tolist()
        bytes_of = self.vocabulary.bytes_of
        for k, i in enumerate(order.tolist()):
            found = tuple(ids[cuts[k] : cuts[k + 1]])
            if b"".join([bytes_of[t] for t in found]) != words[i]:
                raise HashClash("two byte strings share a hash")
            out[i] = found
        return out
