"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The model is a unigram one: a token's log probability falls with its rank (Zipf's law), and a pre-token's
segmentation is the most probable one. Distinct pre-tokens are inserted in a trie whose nodes hold the forward
score of their prefix, so a prefix that words share is scored once; a worker keeps its trie from task to task.
Where a pre-token ends, the token count is kept for all its occurrences.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, table
from .pretokens import VOCABULARY, Words, ranks

#: Words remembered before a worker starts afresh, characters of text whose new words are learned together, nodes of
#: the trie (prefixes beyond are scored, but not kept), Zipf offset.
CACHE, GATHER, NODES, OFFSET = 200_000, 2_000_000, 200_000, 256.0


class TrieCounter:
    """Counts of most probable segmentations, ties to fewer tokens; the trie grows over all calls, within NODES."""

    def __init__(self, by_bytes: dict[bytes, int]):
        total = log(sum(1 / (r + OFFSET) for r in by_bytes.values())) if by_bytes else 0.0
        self.score = {b: -log(r + OFFSET) - total for b, r in by_bytes.items()}
        self.longest = max(map(len, by_bytes), default=0)
        self.starts = {b[:i] for b in by_bytes for i in range(1, len(b) + 1)}
        #: Node of (parent node, byte); forward score and token count of each node's prefix; starts of tokens that may still grow there.
        self.child: dict[int, int] = {}
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.growing: list[tuple[int, ...]] = [()]

    def counts(self, pieces: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """Terminal (tokens, log probability) of each distinct pre-token; a byte without token costs -100.

        Pre-tokens are inserted in byte order, so what two neighbours share stays on the path; from there the
        trie's nodes are followed, and only what it has not seen is scored.
        """
        score, starts, child, known, known_growing, out = self.score, self.starts, self.child, self.forward, self.growing, {}
        path = b""
        forward, growing, nodes = [known[0]], [known_growing[0]], [0]
        for piece in sorted(set(pieces)):
            same, most = 0, min(len(path), len(piece))
            while same < most and path[same] == piece[same]:
                same += 1
            del forward[same + 1 :], growing[same + 1 :], nodes[same + 1 :]
            path, node, size = piece, nodes[-1], len(piece)
            while node >= 0 and same < size and (further := child.get(node << 8 | piece[same])) is not None:
                node = further
                nodes.append(node)
                forward.append(known[node])
                growing.append(known_growing[node])
                same += 1
            for end in range(same + 1, size + 1):
                best, fewest, alive = -1e300, 0, []
                for start in (*growing[end - 1], end - 1):
                    part = piece[start:end]
                    if part in starts:
                        alive.append(start)
                        s = score.get(part)
                        if s is not None:
                            before = forward[start]
                            total, n = before[0] + s, before[1] + 1
                            if total > best or (total == best and n < fewest):
                                best, fewest = total, n
                if not fewest:
                    best, fewest = forward[end - 1][0] - 100.0, forward[end - 1][1] + 1
                forward.append((best, fewest))
                growing.append(tuple(alive))
                if node >= 0 and len(known) < NODES:
                    child[node << 8 | piece[end - 1]] = node = len(known)
                    known.append(forward[-1])
                    known_growing.append(growing[-1])
                else:
                    node = -1
                nodes.append(node)
            out[piece] = (forward[-1][1], forward[-1][0])
        return out


class TextCounter(Words):
    """Tokens of whole texts; recent words are remembered within a bound."""

    def __init__(self, path: str):
        super().__init__()
        self.trie, self.seen = TrieCounter(ranks(path)), {}

    def learn(self, words: list[str]) -> None:
        parts = [[p.encode() for p in self.find(w)] for w in words]
        known, seen = self.trie.counts([p for found in parts for p in found]), self.seen
        for word, found in zip(words, parts, strict=True):
            if len(found) == 1:
                tokens, value = known[found[0]]
                seen[word] = (1, tokens, value)
            else:
                ends = [known[p] for p in found]
                seen[word] = (len(found), sum([e[0] for e in ends]), sum([e[1] for e in ends]))

    def count_batch(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(pre-tokens, tokens, log probability) of each text."""
        for split in self.learned(texts, CACHE, GATHER):
            for found in split:
                rows = list(map(self.seen.__getitem__, found))
                yield sum(map(tuple.__getitem__, rows, repeat(0))), sum(map(tuple.__getitem__, rows, repeat(1))), sum(map(tuple.__getitem__, rows, repeat(2)))


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) of every whole text.

    Null counts as empty and has no tokens; repeated rows count alike; an empty table gives an empty
    result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        c = counter(path)
        for batch in batches:
            rows = list(c.count_batch([t or "" for t in batch.column(1).to_pylist()]))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_pretokens", "n_tokens", "log_prob"])
        gc.enable()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_prob double")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)
