"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols are a doubly linked list in two arrays; a heap holds its adjacent pairs by rank and
place.  Pop the lowest pair, unlink its right symbol, push the pairs that arise; a popped pair whose
symbols have changed since is passed over.  Every merge takes one symbol away, so a word's count is
its number of bytes minus its merges; the count needs no identifiers of the result.

Defined results: a null text counts as empty; the empty text has no bytes and no tokens; equal rows
are counted each; whole texts, whatever their length.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import WORDS, Kept, Vocabulary, spaced_chunks

LIMIT = 512
KEPT_WORDS = 300_000


def _merged(symbols: list[int], merges: dict) -> tuple[list[int], list[int], int]:
    """The symbols after all merges (-1: merged away), the links to the right, number of merges."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for at in range(n - 1):
        found = merges.get((symbols[at], symbols[at + 1]))
        if found:
            heap.append((found[0], at, found[1]))
    heapify(heap)
    gone = 0
    while heap:
        rank, at, new = heappop(heap)
        right = after[at]
        if symbols[at] < 0 or right >= n or merges.get((symbols[at], symbols[right])) != (rank, new):
            continue
        symbols[at], symbols[right] = new, -1
        gone += 1
        following = after[right]
        after[at] = following
        if following < n:
            before[following] = at
            found = merges.get((new, symbols[following]))
            if found:
                heappush(heap, (found[0], at, found[1]))
        leading = before[at]
        if leading >= 0:
            found = merges.get((symbols[leading], new))
            if found:
                heappush(heap, (found[0], leading, found[1]))
    return symbols, after, gone


def chained_merge(ids: list[int], merges: dict) -> list[int]:
    """The symbols that are left, in order."""
    return [s for s in _merged(list(ids), merges)[0] if s >= 0]


def count_merged(ids: list[int], merges: dict) -> int:
    return len(ids) - _merged(list(ids), merges)[2]


class Counter:
    """Counts tokens; remembers the counts of the words and chunks that it met last."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.word = Kept(self._counted, KEPT_WORDS)
        self.spaced = Kept(lambda chunk: self._words(" " + chunk), KEPT_WORDS)

    def _counted(self, word: str) -> int:
        return count_merged(self.vocabulary.word_symbols(word), self.vocabulary.merges)

    def _words(self, piece: str) -> int:
        return sum(map(self.word, WORDS.findall(piece)))

    def _piece(self, piece: str) -> int:
        chunks = spaced_chunks(piece)
        if chunks is None:
            return self._words(piece)
        known, find = self.spaced.young, self.spaced.find
        return self._words(chunks[0]) + sum([known.get(c) or find(c) for c in chunks[1:]])

    def count(self, text: str) -> int:
        pieces = self.vocabulary.pieces(text)
        return len(pieces) // 2 + sum(map(self._piece, pieces[::2]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        count = counter(path).count
        return pa.array([count(t.as_py() or "") for t in texts], pa.int64())

    return run.asNondeterministic()(text)


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
