"""Splitting text into the pre-tokens of a byte-level vocabulary, by the published pattern."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: The code points with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """public_tokenizers.PATTERN for the standard `re`, several times as fast as \\p classes elsewhere.

    The classes \\p{L} and \\p{N} become explicit ranges from the Unicode database, \\s the property
    White_Space (without \\x1c-\\x1f, which `re` would count).
    """
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        kind = ranges.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            if kind and kind[-1][1] == cp - 1:
                kind[-1][1] = cp
            else:
                kind.append([cp, cp])
    text = {k: "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in v) for k, v in ranges.items()}
    pattern = public_tokenizers.PATTERN
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE_SPACE}{text['L']}{text['N']}]")
    pattern = pattern.replace(r"\p{L}", f"[{text['L']}]").replace(r"\p{N}", f"[{text['N']}]")
    return re.compile(pattern.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (lines of base64 and number), or of the public vocabulary of that name."""
    with open(path if "/" in path else public_tokenizers.path(path), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Words:
    """Texts as words of few pre-tokens, so that what is known of a word costs one lookup.

    A single space with no white space on one of its sides always begins a pre-token, so texts are cut
    there. Texts with other runs that hold spaces are split as a whole by the pattern. Subclasses fill
    `seen` for new words in learn().
    """

    seen: dict

    def __init__(self):
        self.find = splitter().findall
        self.odd = re.compile(f"[{WHITE_SPACE}] (?![^{WHITE_SPACE}])").search

    def words(self, text: str) -> list[str]:
        if self.odd(text):
            return self.find(text)
        out = text.split(" ")
        out[1:] = [" " + w for w in out[1:]]
        return out if out[0] else out[1:]

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def learned(self, texts: list[str], cache: int, gather: int) -> Iterator[list[list[str]]]:
        """The words of some texts at a time, about `gather` characters, all of them in `seen`."""
        at = 0
        while at < len(texts):
            room, stop = gather, at
            while stop < len(texts) and (stop == at or room > 0):
                room -= len(texts[stop])
                stop += 1
            split = [self.words(t) for t in texts[at:stop]]
            words = set().union(*split)
            if new := words.difference(self.seen):
                if len(self.seen) > cache:
                    self.seen.clear()
                    new = words
                self.learn(list(new))
            yield split
            at = stop
