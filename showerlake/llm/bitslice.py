"""Bit-sliced comparison of fingerprints inside buckets.

Fingerprints of a batch stand as vertical bit planes, stored once: bit b of lane i is bit i of plane b, 64
lanes to a machine word. Distances of 64 lanes advance together through carry-save adders, eight planes a
step, and a word of lanes is abandoned as soon as each of its distances has passed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .components import Forest

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: Lanes at most this far apart are compared by shifting whole planes; farther ones word by word.
NEAR = 12
#: Words (64 distances each) that are worked at once.
WORDS = 1 << 14


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (int64, or uint8 rows): row b holds bit b of all lanes, two spare words at the end."""
    data = prints.astype("<i8").view(np.uint8).reshape(len(prints), 8) if prints.ndim == 1 else prints
    bits = np.unpackbits(data, axis=1, bitorder="little").T
    padded = np.zeros((len(bits), (len(prints) // 64 + 3) * 64), np.uint8)
    padded[:, : len(prints)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three bits: (sum, carry)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def survivors(plane: Callable[[int, np.ndarray], np.ndarray], planes: int, over: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, bits): which distances stay below 2**counters, counters >= 2; `over` marks lanes that do not count.

    plane(b, words) gives the bits in which plane b differs, for the words still alive.
    """
    live, sums = np.arange(len(over)), [np.zeros(len(over), np.uint64) for _ in range(counters)]
    for at in range(0, planes, 8):
        x = [plane(b, live) for b in range(at, at + 8)]
        twos, fours = [], []
        for k in range(0, 8, 2):
            sums[0], carry = _add(sums[0], x[k], x[k + 1])
            twos.append(carry)
        for k in (0, 2):
            sums[1], carry = _add(sums[1], twos[k], twos[k + 1])
            fours.append(carry)
        if counters == 2:
            over = over | fours[0] | fours[1]
        else:
            sums[2], carry = _add(sums[2], fours[0], fours[1])
            for j in range(3, counters):
                sums[j], carry = sums[j] ^ carry, sums[j] & carry
            over = over | carry
        alive = over != FULL
        if alive.mean() < 0.7:
            live, over, sums = live[alive], over[alive], [s[alive] for s in sums]
            if not len(live):
                break
    return live, ~over


def _lanes(words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, lane) of each set bit."""
    at, lane = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(len(bits), 8), axis=1, bitorder="little"))
    return at, words[at] * 64 + lane


def close_pairs(keys: np.ndarray, prints: np.ndarray, counters: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), some at a time, of rows with equal keys and fewer than 2**counters differing bits; keys must be sorted."""
    n, planes = len(keys), planes_of(prints)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    at, words = np.arange(n), planes.shape[1] - 1
    for d in range(1, NEAR + 1):
        at = at[at + d < end[at]]
        if not len(at):
            return
        mask = np.zeros(words * 64, np.uint8)
        mask[at] = 1
        mask = np.packbits(mask, bitorder="little").view(np.uint64)
        some = np.flatnonzero(mask)
        up, back = np.uint64(d), np.uint64(64 - d)
        shifted = lambda b, live: planes[b, some[live]] ^ (planes[b, some[live]] >> up | planes[b, some[live] + 1] << back)  # noqa: E731, B023
        live, left = survivors(shifted, len(planes), ~mask[some], counters)
        hit = _lanes(some[live], left)[1]
        if len(hit):
            yield hit, hit + d
    # what lies farther apart is in long buckets: each row against the words of its bucket
    at = at[at + NEAR + 1 < end[at]]
    begin, stop = (at + NEAR + 1) >> 6, (end[at] - 1 >> 6) + 1
    for rows in np.array_split(np.arange(len(at)), max(1, int((stop - begin).sum()) // WORDS + 1)):
        if not len(rows):
            continue
        count = (stop - begin)[rows]
        query = np.repeat(at[rows], count)
        word = np.repeat(begin[rows], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        least, most = query + NEAR + 1 - word * 64, end[query] - word * 64  # lanes of the word that count
        mask = np.where(least > 0, FULL << np.clip(least, 0, 63).astype(np.uint64), FULL)
        mask &= np.where(most < 64, ~(FULL << np.clip(most, 0, 63).astype(np.uint64)), FULL)
        home, bit = query >> 6, (query & 63).astype(np.uint64)
        against = lambda b, live: planes[b, word[live]] ^ (np.uint64(0) - (planes[b, home[live]] >> bit[live] & ONE))  # noqa: E731, B023
        live, left = survivors(against, len(planes), ~mask, counters)
        cell, lane = _lanes(word[live], left)
        if len(lane):
            yield query[live[cell]], lane


def bucket_links(keys: np.ndarray, prints: np.ndarray, counters: int = 2, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, root position) of the links among rows with equal keys; keys must be sorted.

    Links (of pairs that `may` allows) join a union-find straight away, so no list of all pairs exists.
    """
    forest = Forest(len(keys))
    for i, j in close_pairs(keys, prints, counters):
        if may is not None:
            some = may(i, j)
            i, j = i[some], j[some]
        if len(i):
            forest.join(i, j)
    moved = np.flatnonzero(forest.flatten() != np.arange(len(keys)))
    return moved, forest.root[moved]


def bucket_edges(links: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]], columns: Callable[[pa.RecordBatch], list[np.ndarray]], node: int):
    """An Arrow batch function for rows sorted by bucket (column 0): edges between the nodes (column `node`) of each bucket.

    Whole buckets go through as they complete; only the last, unfinished one is carried over.
    """

    def made(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = links(rows)
        return pa.RecordBatch.from_arrays([pa.array(rows[node][a]), pa.array(rows[node][b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = columns(batch)
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (cut or held[-1][0][-1] != rows[0][0]):  # the carried bucket ends in this batch
                whole = [np.concatenate(x) for x in zip(*held, [r[:cut] for r in rows], strict=True)]
                yield made(whole)
                held = []
            elif cut:
                yield made([r[:cut] for r in rows])
            held.append([r[cut:] for r in rows])
        if held:
            yield made([np.concatenate(x) for x in zip(*held, strict=True)])

    return run
