"""Phrase collocation mining after Toivonen: a sample proposes, full passes count exactly.

Texts are cut into pieces at punctuation and line ends, pieces into words; a phrase is a run of words
within a piece.  Everything is by language.  A phrase is frequent if it occurs ``min_count`` times.

A sample of the texts (one in ``SAMPLE``, by hash of the row) is mined first; what occurs in it twice or
more is proposed.  The full pass counts the proposals together with their negative border: every word,
and every longer phrase whose two shorter parts (all but the last word, all but the first) are
proposed.  A phrase of the border that turns out to be frequent is a failure of the sample: phrases
that hold it were not counted.  Then another pass counts those alone, and so on until no pass
finds a failure; as phrases grow by a word in each, there are at most ``max_words`` passes.  So every
frequent phrase is counted in exactly one full pass, whatever the sample held.

Tasks know the proposals from Bloom filters of counted size (``BITS`` for each phrase, ``MAX_BITS`` at
most); a false positive is counted in full like any other phrase and falls to ``min_count``, so a
crowded filter costs work, never results.  Tasks sum up before the shuffle.

A candidate of a = f(phrase) is cut after each of its words into a first part (l = f(first)) and the
rest (r = f(rest)); the score ``floor(1000000 * a * a / (l * r))`` of the lowest cut counts.  Products are
decimals of 38 digits, which hold any counts below 10^16.

Defined results: null and empty texts have no words; language null is ``und``.  Repeated rows count
each.  Whole texts are read, of any length.  An empty table gives an empty result.  Columns
other than ``text`` and ``lang`` take no part, save that the sample is drawn by a hash of ``doc_id`` too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import discard, stored

MIN_COUNT, MAX_WORDS = 10, 3
SAMPLE, SAMPLE_COUNT = 16, 2
CHUNK = 3_000_000  # bytes of text that a task counts at a time
ROWS_AT_ONCE = 50_000
BITS, MAX_BITS, SHARD = 16, 1 << 30, 1 << 20

_END = ord(".")
_ENDS, _UPPER = {*b".,;:!?\n\x0b\x0c\r"}, range(ord("A"), ord("Z") + 1)
_TABLE = bytes(
    b + 32 if b in _UPPER else _END if b in _ENDS else ord(" ") if b == ord("\t") else b for b in range(256)
)
COUNTS = "lang string, words int, phrase binary, f long"


def split_words(texts: list[bytes]) -> pa.Array:
    """The words of all texts in order; a full stop, which no word holds, ends each piece."""
    data = b".".join(texts).translate(_TABLE).replace(b".", b" . ")
    bounds = np.array([0, len(data)], np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    words = pc.ascii_split_whitespace(whole).values.cast(pa.large_binary())
    return words.filter(pc.not_equal(pc.binary_length(words), 0))


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def extended(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (last + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits.bit_length() + 1), (hashes * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits.bit_length() + 1)


def _holds(filters: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hashes), bool)
    for filter_ in filters:
        hit = np.ones(len(hashes), bool)
        for place in _places(hashes, len(filter_) * 8):
            hit &= (filter_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        found |= hit
    return found


def _phrase_hashes(phrases: pa.Array, langs: list[str]) -> np.ndarray:
    out = np.empty(len(phrases), np.uint64)
    for i, (phrase, lang) in enumerate(zip(phrases.to_pylist(), langs)):
        seed = xxhash.xxh32_intdigest(lang.encode())
        first, *rest = (np.array([xxhash.xxh64_intdigest(w, seed)], np.uint64) for w in phrase.split(b" "))
        for word in rest:
            first = extended(first, word)
        out[i] = first[0]
    return out


def bloom_filter(phrases: DataFrame) -> np.ndarray | None:
    """Bits of all phrases; tasks set those of one shard each, and shards come to the driver as they
    are broadcast: ``MAX_BITS`` at most."""
    n = phrases.count()
    if n == 0:
        return None
    bits = min(MAX_BITS, max(SHARD, 1 << (BITS * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _phrase_hashes(batch.column("phrase"), batch.column("lang").to_pylist())
            place = np.concatenate(_places(hashes, bits)).astype(np.int64)
            yield pa.record_batch({"shard": pa.array((place // SHARD).astype(np.int32)), "bit": pa.array((place % SHARD).astype(np.int32))})

    def shard(table: pa.Table) -> pa.Table:
        own = np.zeros(SHARD, np.uint8)
        own[table["bit"].to_numpy()] = 1
        data = np.packbits(own, bitorder="little").tobytes()
        return pa.table({"shard": table["shard"].slice(0, 1), "data": pa.array([data], pa.binary())})

    rows = phrases.select("lang", "phrase").mapInArrow(places, "shard int, bit int").distinct()
    shards = rows.groupBy("shard").applyInArrow(shard, "shard int, data binary").collect()
    whole = np.zeros(bits // 8, np.uint8)
    for row in shards:
        whole[row.shard * (SHARD // 8) : (row.shard + 1) * (SHARD // 8)] = np.frombuffer(row.data, np.uint8)
    return whole


def _counted(lang: str, texts: list[bytes], max_words: int, now: dict | None, before: dict | None) -> Iterator[pa.RecordBatch]:
    """Counts of one chunk.  ``now`` and ``before`` have filters by phrase length: this pass counts what
    ``now`` lets pass (None: all), less what ``before`` let an earlier pass count (None: it is the first)."""

    def rows(length: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(counts), ROWS_AT_ONCE):
            some = counts[start : start + ROWS_AT_ONCE].astype(np.int64)
            yield pa.record_batch({
                "lang": pa.repeat(pa.scalar(lang, pa.string()), len(some)),
                "words": pa.array(np.full(len(some), length, np.int32)),
                "phrase": phrases.slice(start, len(some)).cast(pa.binary()),
                "f": pa.array(some),
            })

    words = split_words(texts)
    if len(words) == 0:
        return
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    hashes = word_hashes(known, lang)
    end = pc.index(known, pa.scalar(b".", known.type)).as_py()
    real = ids != end
    if before is None:
        counts = np.bincount(ids[real], minlength=len(known))
        used = np.flatnonzero(counts)
        yield from rows(0, pa.array([b""], pa.binary()), np.array([real.sum()]))
        yield from rows(1, known.take(pa.array(used)), counts[used])
    # at[i]: the number of the phrase that begins at word i, -1 where there is none or it can't matter.
    at, names, own = np.where(real, ids, -1), known, hashes
    # done[i]: an earlier pass counted phrase i.  A false positive of ``before`` alone doesn't say so.
    done = np.full(len(known), before is not None)
    for length in range(2, max_words + 1):
        passes = np.ones(len(own), bool) if now is None else _holds(now[length - 1], own)
        last = ids[length - 1 :]
        left, right = at[: len(last)], at[1 : len(last) + 1]
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        ok = ok[passes[left[ok]] & passes[right[ok]]]
        code, number, counts = np.unique(left[ok] * len(known) + last[ok], return_inverse=True, return_counts=True)
        if len(code) == 0:
            return
        new = np.ones(len(code), bool)
        if before is not None:
            old, place = done & _holds(before[length - 1], own), np.empty(len(code), np.int64)
            place[number] = ok
            new = ~(old[left[place]] & old[right[place]])
        done = ~new
        at = np.full(len(last), -1, np.int64)
        at[ok] = number
        heads, tails = code // len(known), code % len(known)
        own = extended(own[heads], hashes[tails])
        names = pc.binary_join_element_wise(names.take(pa.array(heads)), known.take(pa.array(tails)), pa.scalar(b" ", names.type))
        if new.any():
            yield from rows(length, names.filter(pa.array(new)), counts[new])


def count_phrases(texts: DataFrame, max_words: int, filters=None) -> DataFrame:
    """``lang, words, phrase, f`` of a pass over ``lang, text``; the first pass has the number of all words of a
    language under length 0.  ``filters`` is a broadcast pair of filters now and before, see ``_counted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = (None, None) if filters is None else filters.value
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            langs, data = batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()
            for lang, text in zip(langs, data):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK:
                    for each, own in held.items():
                        yield from _counted(each, own, max_words, now, before)
                    held, size = {}, 0
        for each, own in held.items():
            yield from _counted(each, own, max_words, now, before)

    return texts.mapInArrow(count, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(
    documents: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample: int = SAMPLE
) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, words, phrase, f`` of all phrases of up to ``max_words`` words that occur ``min_count`` times, and
    of length 0 the number of words of a language.  Also gives the stored tables to discard."""
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        (F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).alias("drawn"),
    )
    drawn = count_phrases(texts.where("drawn").select("lang", "text"), max_words - 1)
    proposed = stored(drawn.where((F.col("f") >= SAMPLE_COUNT) & (F.col("words") > 0)), "phrases-proposed")
    lengths = range(1, max_words)
    before, fresh, passes, used = None, proposed, [], [proposed]
    now: dict[int, list[np.ndarray]] = {n: [] for n in lengths}
    while True:
        added = {n: bloom_filter(fresh.where(F.col("words") == n)) for n in lengths}
        now = {n: now[n] + ([added[n]] if added[n] is not None else []) for n in lengths}
        filters = spark.sparkContext.broadcast((now, before))
        counts = count_phrases(texts.select("lang", "text"), max_words, filters)
        found = stored(counts.where((F.col("f") >= min_count) | (F.col("words") == 0)), "phrases-pass")
        filters.destroy()
        passes.append(found)
        # Failures of the border: frequent, but nothing that holds them was counted.
        fresh = found.where(F.col("words").between(1, max_words - 1))
        if before is None:
            fresh = fresh.join(proposed, ["lang", "words", "phrase"], "left_anti")
        fresh = stored(fresh, "phrases-failures")
        used += [found, fresh]
        before = now
        if fresh.isEmpty():
            break
    whole = passes[0]
    for found in passes[1:]:
        whole = whole.unionByName(found)
    return whole.withColumn("phrase", F.col("phrase").cast("string")), used


def _first_words(words: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def lowest_cuts(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every frequent phrase of two words or more."""
    key = F.concat("lang", F.lit("\t"), "phrase")  # a phrase holds no tab
    known = frequent.where("words > 0").select(key.alias("key"), "f")
    words = F.split("phrase", " ")
    cuts = frequent.where("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    rest = F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cuts = cuts.withColumn("key", F.concat("lang", F.lit("\t"), _first_words(words, F.col("k"))))
    cuts = cuts.withColumn("rest", F.concat("lang", F.lit("\t"), rest))
    cuts = salted_join(cuts, known.withColumnRenamed("f", "l"), "key", "inner").drop("key").withColumnRenamed("rest", "key")
    cuts = salted_join(cuts, known.withColumnRenamed("f", "r"), "key", "inner").drop("key")
    exact = "cast({} as decimal(16, 0))".format
    score = F.expr(f"({exact('a')} * {exact('a')} * 1000000bd) div ({exact('l')} * {exact('r')})").cast("long")
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _covered(frequent: DataFrame, max_words: int) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a longer frequent phrase that holds the phrase."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ))
    parts = frequent.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    documents: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = 2_000,
    cover_percent: int = 50,
    sample: int = SAMPLE,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score, count and
    text, without those that ``cover_percent`` of 100 occurrences of lie in one longer phrase."""
    frequent, used = frequent_phrases(documents, min_count, max_words, sample)
    frequent = stored(frequent, "phrases-frequent")
    discard(*used)
    scored = lowest_cuts(frequent).join(_covered(frequent, max_words), ["lang", "phrase"], "left")
    open_ = scored.where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    rows = ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
    answer = stored(rows, "phrases")
    discard(frequent)
    return answer
