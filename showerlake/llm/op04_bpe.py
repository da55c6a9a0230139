"""Byte-level BPE by prefix dynamic programming, and back.

For byte-pair encoding by ranks, the encoding of any prefix ends in exactly one token: the one whose
predecessor is the last token of the shorter prefix and that may stand next to it. So a table of one
token per prefix holds the encodings of all prefixes; an append extends it, and an edit recomputes it
from the edit until it agrees again with the shifted old table over the longest token's length.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, slices, table
from .lanes import WIDEST, HashClash, Lanes
from .pretokens import VOCABULARY, Words, ranks

#: Words remembered by a task before it starts afresh, characters of text whose new words are learned together,
#: and pre-tokens that share a pass of lanes.
CACHE = 200_000
GATHER = 2_000_000
#: The first two in the pipeline, whose stages share the executors' memory with idle workers of other stages.
LEAN = (100_000, 1_000_000)
SHARE = 32_768
#: Ids of an output batch.
FLUSH = 1_000_000


class Vocabulary:
    """Ranks, and which two tokens may stand side by side in an encoding."""

    def __init__(self, by_bytes: dict[bytes, int]):
        self.by_bytes = by_bytes
        self.bytes_of = [b""] * (max(by_bytes.values(), default=-1) + 1)
        for b, t in by_bytes.items():
            self.bytes_of[t] = b
        self.sizes = list(map(len, self.bytes_of))
        self.longest = max(self.sizes, default=1)
        self.known_sound: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain repeated merging of the lowest-ranked neighbours, leftmost first."""
        out = [self.by_bytes[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(((self.by_bytes.get(self.bytes_of[a] + self.bytes_of[b], len(self.bytes_of)), i) for i, (a, b) in enumerate(zip(out, out[1:]))))
            if best[0] == len(self.bytes_of):
                break
            out[best[1] : best[1] + 2] = [best[0]]
        return out

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte or a token that merging never reaches."""
        if token not in self.parts:
            data, found = self.bytes_of[token], None
            if len(data) > 1:
                out = [self.by_bytes[data[i : i + 1]] for i in range(len(data))]
                while len(out) > 2:
                    rank, i = min((self.by_bytes.get(self.bytes_of[a] + self.bytes_of[b], token), i) for i, (a, b) in enumerate(zip(out, out[1:])))
                    if rank >= token:
                        break
                    out[i : i + 2] = [rank]
                found = (out[0], out[1]) if len(out) == 2 else None
            self.parts[token] = found
        return self.parts[token]

    def sound(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self.known_sound.get(token)
        if known is None:
            known = self.known_sound[token] = self.sizes[token] == 1 or self.split(token) is not None
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that made them.

        Walks back in time: the later-made of the two border tokens is taken apart, and at each point
        the pair that then faced each other must not merge before the next event on either side.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        a, b, until, none = left, right, len(self.bytes_of), len(self.bytes_of)
        ok = True
        while True:
            rank = self.by_bytes.get(self.bytes_of[a] + self.bytes_of[b], none)
            # at equal rank the leftmost merge goes first: the border lies right of what made `a`, left of what made `b`
            if rank < until:
                ok = False
                break
            inner_a, inner_b = self.split(a), self.split(b)
            if inner_a is None and inner_b is None:
                break
            if inner_b is None or (inner_a is not None and a > b):
                until, a = a, inner_a[1]
            else:
                until, b = b + 1, inner_b[0]
        if len(self.beside) > 2_000_000:
            self.beside.clear()
        self.beside[left, right] = ok
        return ok


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, []
        self._extend(len(data))

    def _extend(self, stop: int) -> None:
        """Fill the table up to the prefix of `stop` bytes."""
        v, data, last = self.vocabulary, self.data, self.last
        get, beside, longest, sound = v.by_bytes.get, v.beside, v.longest, v.sound
        for end in range(len(last) + 1, stop + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is None or not sound(token):
                    continue
                if start:
                    pair = (last[start - 1], token)
                    ok = beside.get(pair)
                    if not (v.fit(*pair) if ok is None else ok):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def restart(self, data: bytes) -> None:
        """Turn to other bytes, keeping the prefixes they share with the present ones."""
        same, old = 0, self.data
        most = min(len(old), len(data))
        while same < most and old[same] == data[same]:
            same += 1
        del self.last[same:]
        self.data = data
        self._extend(len(data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, agree = old[:start], 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            agree = agree + 1 if end > start + len(new) and self.last[-1] == old[end - 1 - shift] else 0
            if agree >= self.vocabulary.longest:
                self.last += old[end - shift :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end, sizes = [], len(self.data), self.vocabulary.sizes
        while end:
            out.append(self.last[end - 1])
            end -= sizes[out[-1]]
        return out[::-1]


class Encoder(Words):
    """Text to ids and back; recent words are remembered within a bound."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary, self.seen = Vocabulary(ranks(path)), {}
        self.lanes = Lanes(self.vocabulary)

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words; their pre-tokens share one pass of prefix tables."""
        whole, parts = self.vocabulary.by_bytes, list(map(self.find, words))
        pieces = list({p for found in parts for p in found})
        raw = [p.encode() for p in pieces]
        ids, short = {}, []
        for piece, data in zip(pieces, raw, strict=True):
            if (token := whole.get(data)) is not None:  # a pre-token of the vocabulary is one token
                ids[piece] = (token,)
            elif len(data) <= WIDEST:
                short.append((piece, data))
            else:
                ids[piece] = tuple(PrefixTable(self.vocabulary, data).tokens())
        short.sort(key=lambda pair: len(pair[1]))  # lanes of about equal length, so that no pass is wider than it must be
        for at in range(0, len(short), SHARE):
            part = short[at : at + SHARE]
            try:
                found = self.lanes.encode([d for _, d in part])
            except HashClash:
                found = [tuple(PrefixTable(self.vocabulary, d).tokens()) for _, d in part]
            ids.update(zip([p for p, _ in part], found, strict=True))
        self.seen.update((w, ids[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, found)))) for w, found in zip(words, parts, strict=True))

    def encode_batch(self, texts: list[str], cache: int = CACHE, gather: int = GATHER) -> Iterator[list[int]]:
        """Ids of each text; unknown words of some texts at a time are learned together."""
        ids = self.seen.__getitem__
        for split in self.learned(texts, cache, gather):
            for found in split:
                yield list(chain.from_iterable(map(ids, found)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, digests: bool = False, cache: int = CACHE, gather: int = GATHER) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, or (doc_id, n_tokens, ids_sha256, decoded_sha256) with `digests`.

    Null counts as empty; an empty text has no ids. Row by row within Arrow batches, so order, ties and
    repeated rows do not matter and memory is bounded by a batch; other columns are not read. `path` is a rank
    file, or the name of one that each worker finds for itself.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"

    def made(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        if digests:
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        else:
            columns = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays([doc_ids, *columns], [part.split()[0] for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here, and walking the remembered words over and over is dear
        e = encoder(path)
        names = list(map(str, range(len(e.vocabulary.bytes_of))))
        for batch in slices(batches):
            rows, room, at = [], FLUSH, 0
            for ids in e.encode_batch([t or "" for t in batch.column(1).to_pylist()], cache, gather):
                decoded = e.decode(ids)
                if digests:
                    rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    rows.append((np.array(ids, np.int32), decoded))
                room -= len(ids)
                if room < 0:
                    yield made(batch.column(0).slice(at, len(rows)), rows)
                    rows, room, at = [], FLUSH, at + len(rows)
            yield made(batch.column(0).slice(at, len(rows)), rows)
        e.seen.clear()
        gc.enable()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row, whatever its other columns.

    Null and empty texts have no ids; rows that repeat an id or a text each give their row; very long texts
    are encoded whole; an empty table gives an empty result.
    """
    out = encode_documents(docs, VOCABULARY, cache=LEAN[0], gather=LEAN[1])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
