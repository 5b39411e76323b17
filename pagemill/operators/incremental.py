"""Runs that go on where the last one ended.

Done pages lie in one folder for each batch, so a batch that is written again replaces itself.  Beside
them, batch by batch, lie the bits of a Bloom filter over their URLs: ``RANGES`` ranges of URL hashes
with ``WORDS`` words of 64 bits each.  Its size is fixed (8 MB), so it can be broadcast whatever has been done.  Pages
whose bits are not all set are new for certain; only the others are compared with the done URLs.
With very many URLs the filter fills up and more pages are compared; the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedupe import first_rows

RANGES, WORDS, HASHES = 4_096, 256, 4
DONE = "page_id bigint, url string, next_url string, finished boolean"
BITS = "range int, word int, bits bigint"


def _range(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(RANGES)).cast("int")


def _places(url: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(url, F.lit(n)), F.lit(WORDS * 64)).cast("int") for n in range(HASHES)]


def url_bits(urls: DataFrame, url: str = "url") -> DataFrame:
    """``range, word, bits``: the words of the filter in which the URLs set bits."""
    set_ = urls.select(_range(F.col(url)).alias("range"), F.explode(F.array(*_places(F.col(url)))).alias("place"))
    bit = F.expr("shiftleft(1L, place % 64)")
    return set_.groupBy("range", F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _whole_words(bits: DataFrame) -> DataFrame:
    """``range, words``: the words of a range as one array; at most ``RANGES`` rows."""

    def whole(part: pa.Table) -> pa.Table:
        words = np.zeros(WORDS, np.int64)
        np.bitwise_or.at(words, part["word"].to_numpy(), part["bits"].to_numpy())
        return pa.table({"range": part["range"].slice(0, 1), "words": pa.array([words], pa.list_(pa.int64()))})

    return bits.groupBy("range").applyInArrow(whole, "range int, words array<bigint>")


def maybe_seen(pages: DataFrame, bits: DataFrame, url: str = "url") -> DataFrame:
    """The pages with ``maybe``: false where the URL is none of those that set ``bits``."""
    words = F.broadcast(_whole_words(bits).withColumnRenamed("range", "_range"))
    found = pages.withColumn("_range", _range(F.col(url))).join(words, "_range", "left")
    maybe = F.lit(True)
    for place in _places(F.col(url)):
        word = F.get("words", F.floor(place / 64).cast("int"))
        maybe = maybe & (F.call_function("shiftright", word, place % 64).bitwiseAND(F.lit(1)) == 1)
    return found.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("_range", "words")


def pending_pages(pages: DataFrame, done: DataFrame, url: str = "url", bits: DataFrame | None = None) -> DataFrame:
    """Pages whose URL is not in ``done``.  ``bits`` is the stored filter of the done URLs (``done_bits``); without it,
    it is made from them."""
    if bits is None:
        bits = url_bits(done, url)
    flagged = maybe_seen(pages, bits, url)
    compared = flagged.where("maybe").join(done.select(url), url, "left_anti")
    return flagged.where(~F.col("maybe")).unionByName(compared).select(*pages.columns)


def mark_done(batch: DataFrame, path: str, finished: bool = False, batch_id: str | int | None = None) -> None:
    """Add processed pages, with ``page_id, url, next_url``, to those done.

    A batch is known by ``batch_id``, as a stream gives it, or else by the hash of its rows: one that is
    written twice, say because its run failed after the first time, counts once."""
    rows = batch.select("page_id", "url", F.coalesce("next_url", F.lit("")).alias("next_url"), F.lit(finished).alias("finished"))
    if batch_id is None:
        sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        batch_id = f"{sums.n}x{sums.h}".replace("-", "m")
    url_bits(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/_bits/batch={batch_id}")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def done_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DONE + ", batch string").parquet(path).drop("batch")


def done_bits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BITS + ", batch string").parquet(f"{path}/_bits").drop("batch")


def latest_by_key(history: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row of each key; of rows that tie one stays."""
    return first_rows(history, [key], order, last=True)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replace rows of the same key and add new ones; among changes the last one counts."""
    fresh = latest_by_key(changes, key, order)
    return remove(table, fresh, key).unionByName(fresh)


def remove(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)
