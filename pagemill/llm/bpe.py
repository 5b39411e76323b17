"""Byte-pair encoding and decoding as the ``tokenizers`` library does it with a byte-level vocabulary.

Text is cut at the special tokens' strings, then into words by the byte-level pattern, and each word
is merged on its own.  A short word is a contiguous array of part boundaries and of the ranks of
adjacent parts: scan for the smallest rank, delete that boundary, look up the two ranks beside it
again, until no pair has a rank.  Words of more than ``LONG_WORD`` bytes, for which scanning would be
quadratic, are merged with the heap of ``token_counts``.  A task remembers the ids of the words and of
the space-separated chunks that it met last, a bounded number of them.

Defined results: a null text counts as empty; an empty text has no ids; equal rows are encoded each.
Texts are encoded whole, whatever their length.  Of the table only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_counts import chained_merge
from .vocabulary import WORDS, Kept, Vocabulary, spaced_chunks

LONG_WORD = 64
KEPT_WORDS = 150_000
#: No rank, and no id of both together.
NONE = (1 << 60, -1)
#: Letters and then marks: a space and the letters are one word of the pattern, the marks another.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def contiguous_merge(ids: list[int], merges: dict) -> list[int]:
    """Merge the lowest-ranked adjacent pair, the leftmost of equals, until none has a rank."""
    parts, found = list(ids), merges.get
    ranks = list(map(found, zip(parts, parts[1:], strict=False), repeat(NONE)))
    while ranks:
        lowest = min(ranks)
        if lowest is NONE:
            break
        at = ranks.index(lowest)
        new = parts[at] = lowest[1]
        del parts[at + 1], ranks[at]
        if at < len(ranks):
            ranks[at] = found((new, parts[at + 1]), NONE)
        if at:
            ranks[at - 1] = found((parts[at - 1], new), NONE)
    return parts


class Codec:
    """Text to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.word = Kept(self._merged, KEPT_WORDS)
        self.spaced = Kept(self._spaced, KEPT_WORDS)

    def _merged(self, word: str) -> tuple[int, ...]:
        symbols = self.vocabulary.word_symbols(word)
        merge = contiguous_merge if len(symbols) <= LONG_WORD else chained_merge
        return tuple(merge(symbols, self.vocabulary.merges))

    def _spaced(self, chunk: str) -> tuple[int, ...]:
        simple = SIMPLE.fullmatch(chunk)
        if simple is None:
            return tuple(self._words(" " + chunk))
        letters, marks = simple.groups()
        ids = self.word(" " + letters)
        return ids + self.word(marks) if marks else ids

    def _words(self, piece: str) -> list[int]:
        return list(chain.from_iterable(map(self.word, WORDS.findall(piece))))

    def _piece(self, piece: str) -> list[int]:
        chunks = spaced_chunks(piece)
        if chunks is None:
            return self._words(piece)
        ids = self._words(chunks[0])
        known, find = self.spaced.young, self.spaced.find
        ids.extend(chain.from_iterable([known.get(c) or find(c) for c in chunks[1:]]))
        return ids

    def encode(self, text: str) -> list[int]:
        pieces = self.vocabulary.pieces(text)
        ids = self._piece(pieces[0])
        for special, piece in zip(pieces[1::2], pieces[2::2], strict=True):
            ids.append(self.vocabulary.special[special])
            ids.extend(self._piece(piece))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(text: Column, path: str, with_ids: bool = False) -> Column:
    """``n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for: the text encoded, and
    decoded again from the ids."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        both = codec(path)
        named = list(map(str, range(len(both.vocabulary.bytes_of))))
        counts, of_ids, of_text, rows = [], [], [], []
        for text in texts:
            ids = both.encode(text.as_py() or "")
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(named.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(both.decode(ids).encode()).hexdigest())
            if with_ids:
                rows.append(np.array(ids, dtype=np.int32))
        columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ends = np.cumsum([0, *counts], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *rows])))
            names.append("ids")
        return pa.StructArray.from_arrays(columns, names=names)

    return run.asNondeterministic()(text)


def encode_documents(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for."""
    rows = documents.select("doc_id", encoded(F.col("text"), path, with_ids).alias("e"))
    return rows.select("doc_id", "e.*")
