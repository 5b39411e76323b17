"""Token ids in Parquet list columns, written in document order and read selectively.

A row holds a document's ids as a list, their number, and where they start among the ids of its file.
Files are written in ascending doc_id order, one for each range of ids.  Ids are dictionary-encoded
(a vocabulary of 50,000 fits one dictionary page) or delta-encoded; row groups, data pages and the
rows of a page are bounded, and the writer adds page indexes, so a reader of ``n_tokens`` never
touches ids, and one of a few documents only their pages.  A document's start in the whole corpus is
its start in the file and the ids of the files before, one number for each file.

The ids are the ``tokenizers`` library's.  Words don't go over spaces or line ends, which that
tokenizer drops, nor over a letter and marks, so a task cuts texts there, some megabytes at a time, has
the library encode each different chunk once while it remembers it, and puts texts together from these.
Words of Latin-1 letters alone go to the library's model without its normalizer and patterns, which
leave such a word in small letters as it is.

Defined results: a null text is empty, and has the end id alone.  Rows with equal doc_id are each
written, in the order of a hash of their texts; rows without doc_id come first.  An empty table gives
no rows.  Texts are encoded whole.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocabulary import byte_symbols

END_ID = 2
KEPT_CHUNKS = 500_000
KEPT_CHARS = 64
#: Letters of Latin-1: a run of them is one word of the tokenizer's pattern, a run of ASCII marks that ends a chunk another.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LETTERS = re.compile(f"[{LATIN}]+")
ENDED = rf"([{LATIN}])([!-/:-@\[-`{{-~]+)( |$)"
#: The bytes of the others of them as the tokenizer writes them.
SYMBOLS = {n: "".join(byte_symbols()[b] for b in chr(n).encode()) for n in range(0xA0, 0x100)}
WORD_END = "</w>"
WORDS_AT_ONCE = 2_000
TEXT_BYTES = 1 << 20  # of texts that are encoded at a time, if these are more than one
WRITTEN = "doc_id long, part int, at long, n_tokens int, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same model without the rest, for words that are cut and in small letters already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of small Latin-1 letters, encoded as one text: the last id of each says that it ends a word."""
        text = " ".join([w.lower() if w.isascii() else w.lower().translate(SYMBOLS) for w in words])
        found = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
        if len(ends) != len(words):  # a tokenizer that doesn't mark where words end
            return self._encoded(words)
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has.  A different chunk is looked up once."""
        spaced = pc.replace_substring(texts, "\n", " ")
        plain = pc.replace_substring_regex(pc.ascii_lower(spaced), ENDED, r"\1 \2\3")
        # Special tokens hold marks, and are found before letters are made small.
        chunks = pc.split_pattern(pc.if_else(pc.match_substring(spaced, "<|"), spaced, plain), " ")
        coded = chunks.flatten().dictionary_encode()
        codes, known = coded.indices.to_numpy(), self.chunk_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), dtype="<u4")
        own = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(starts[codes] - ends[:-1], own) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy())])
        return ids, np.diff(ends[bounds])

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        parts = list(map(self.young.get, chunks))
        missing = [n for n, p in enumerate(parts) if p is None]
        if missing:
            made = self.find({chunks[n] for n in missing})
            for n in missing:
                parts[n] = made[chunks[n]]
        return parts

    def find(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in ``young``."""
        if len(self.young) >= KEPT_CHUNKS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        made, words, rest = {}, [], []
        for chunk in missing:
            found = old.get(chunk)
            if found is not None:
                made[chunk] = found
            else:
                (words if LETTERS.fullmatch(chunk) else rest).append(chunk)
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            made.update(zip(some, self._words(some), strict=True))
        made.update(zip(rest, self._encoded(rest), strict=True))
        young.update(made if max(map(len, made)) <= KEPT_CHARS else {c: p for c, p in made.items() if len(c) <= KEPT_CHARS})
        return made


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_ids(
    documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, encoding: str = "dictionary"
) -> None:
    """Encode the texts and write them to ``folder`` in ascending doc_id order."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = ["doc_id", "tie"]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ordered.mapInArrow(_encoded(tokenizer, end_id), WRITTEN)
    written.write.options(**LAYOUT, **ENCODINGS[encoding]).parquet(folder)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``TEXT_BYTES`` or little more, and of a text at least."""
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])
    start = 0
    while start < len(texts):
        stop = min(int(np.searchsorted(before, before[start] + TEXT_BYTES)), len(texts))
        yield start, stop
        start = stop


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode_all
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for start, stop in _slices(texts):
                ids, sizes = encode(texts.slice(start, stop - start))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
                sizes = sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(at + ends[:-1]),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(ends.astype(np.int32), ids),
                    ],
                    names=["doc_id", "part", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    return run


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, part, at, n_tokens, ids`` as written; take the columns you need."""
    return spark.read.schema(WRITTEN).parquet(folder)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part, before``: the ids in the files before each; one row for each file."""
    sizes = read_token_ids(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def crc32_of_ids(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        flat, ends = np.asarray(lists.flatten(), dtype="<u4"), np.cumsum([0, *np.asarray(lists.value_lengths())])
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array(sums, pa.int64())

    return run.asNondeterministic()(ids)


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, read from the files."""
    rows = read_token_ids(spark, folder)
    rows = rows.select("doc_id", "part", "at", "n_tokens", crc32_of_ids(F.col("ids")).alias("ids_crc32"))
    # One row for each file, of which there are as many as shuffle partitions.
    whole = rows.join(F.broadcast(file_starts(spark, folder)), "part")
    return whole.select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
