"""A byte-level BPE vocabulary file, and the cutting of text into chunks that are merged alone."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

#: Fixed value: the byte-level pattern of the public vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space with white space, or nothing more, on both sides can be inside a word of the pattern.
INSIDE = re.compile(r"\s (?:\s|\Z)")
KEPT_CHARS = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one
    from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, bytes and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        ids = parts["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [ids[s] for s in symbols]
        #: (left id, right id) -> (rank, id of both together)
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(parts["model"]["merges"])
        }
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        named = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        named |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [named.get(i, b"") for i in range(max(named, default=-1) + 1)]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def word_symbols(self, word: str) -> list[int]:
        return [self.byte_ids[b] for b in word.encode("utf-8")]

    def pieces(self, text: str) -> list[str]:
        """The text between special tokens, and at odd places the special tokens."""
        return self.cut.split(text) if self.cut else [text]


class Kept[V]:
    """What was made of the last chunks: two generations of at most ``limit`` entries each."""

    def __init__(self, make: Callable[[str], V], limit: int):
        self.make, self.limit = make, limit
        self.young: dict[str, V] = {}
        self.old: dict[str, V] = {}

    def find(self, chunk: str) -> V:
        """For a chunk that is not in ``young``."""
        found = self.old.get(chunk)
        if found is None:
            found = self.make(chunk)
            if len(chunk) > KEPT_CHARS:
                return found
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def __call__(self, chunk: str) -> V:
        found = self.young.get(chunk)
        return self.find(chunk) if found is None else found


def spaced_chunks(piece: str) -> list[str] | None:
    """The piece cut at spaces, if no word of the pattern goes over one of them, else None.

    Every chunk but the first stands for a space and itself.
    """
    return None if INSIDE.search(piece) else piece.split(" ")
