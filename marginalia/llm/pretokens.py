"""Splitting text by a tokenizer's pattern, and memoising what pieces of text encode to."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: The White_Space characters of Unicode; letters and numbers below U+0250.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts without characters from here on are split by the standard library, which is faster.
LATIN_END = "ɐ"


def _spelled(pattern: str, letter: str, number: str) -> str:
    """``pattern`` with classes written out, first inside its brackets and then outside."""
    inside = {r"\s": SPACE, r"\p{L}": letter, r"\p{N}": number}
    outside = {r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]", r"\p{L}": f"[{letter}]", r"\p{N}": f"[{number}]"}

    def swap(text: str, table: dict[str, str]) -> str:
        return re.sub("|".join(map(re.escape, table)), lambda m: table[m[0]], text)

    return "".join(
        swap(part, inside if part.startswith("[") else outside) for part in re.split(r"(\[[^\]]*\])", pattern)
    )


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text, in order."""
    latin = re.compile(_spelled(pattern, LETTER, NUMBER)).findall
    general = regex.compile(_spelled(pattern, r"\p{L}", r"\p{N}")).findall

    def split(text: str) -> list[str]:
        return latin(text) if not text or text.isascii() or max(text) < LATIN_END else general(text)

    return split


#: Pieces longer than this are made anew each time, so that what a worker remembers is bounded in bytes.
LONGEST = 64


class Memo(dict):
    """``key -> make(key)`` for at most twice ``limit`` keys of LONGEST at most, those used lately among them."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Between texts: past the limit the older half is forgotten."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
