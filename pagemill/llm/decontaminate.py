"""Benchmark decontamination by a broadcast hash set of n-grams; DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters after A-Z are made small; nothing else is
folded.  A window is ``n`` consecutive words of an item, or all words of an item that has fewer.
The hashes of all windows of a text come from the hashes of its words by doubling (1, 2, 4, 8, ...
words), so that a window costs two steps whatever its length.  They are looked up in the set of
benchmark windows, and each hit is verified word by word before it counts.

The set is broadcast while it has at most ``broadcast_windows`` rows (counted; some hundred bytes
each); only hits and one row for each text then go into the shuffle, summed up before it by task.
Beyond that the hashes of windows meet the set by shuffle, and the hits of a text are brought to its
words to be verified, with the same result.  No window carries its text along, so both ways
take time in proportion to a text's length.

Defined results: a null or wordless text has no words and no hits; null or wordless items have no
window.  Items with equal windows all count.  An item without id marks words but isn't counted.
Documents with equal ``doc_id`` and text are returned as often as they occur; those with equal
``doc_id`` and other text are judged on their own.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    small = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(small, F.lit(f"({WORD}+)"), 1)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(left: Column, right: Column, shift: int) -> Column:
    """Hashes of left[i] followed by right[i + shift]."""
    n = F.greatest(F.size(left) - shift, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), n),
        F.slice(right, F.lit(shift + 1), n),
        lambda a, b: F.xxhash64(a, b),
    )


def windows_by_length(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``w<n>``, the hashes of all windows of n words, from ``w1``, for each length asked for."""
    have = {1: "w1"}
    power = 1
    while power * 2 <= max(lengths, default=1):
        df = df.withColumn(f"p{power * 2}", _joined(F.col(have[power]), F.col(have[power]), power))
        have[power * 2] = f"p{power * 2}"
        power *= 2
    for n in lengths:
        done, column = 0, None
        for bit in (b for b in sorted(have, reverse=True) if n & b):
            part = F.col(have[bit])
            # The longer part comes first; of the shorter one, the window that follows.
            column = part if column is None else _joined_to(column, part, done, n)
            done += bit
        df = df.withColumn(f"h{n}", column)
    return df


def _joined_to(left: Column, right: Column, done: int, n: int) -> Column:
    width = F.greatest(F.least(F.size(left), F.size(right) - done), F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), width),
        F.slice(right, F.lit(done + 1), width),
        lambda a, b: F.xxhash64(a, b),
    )


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``length, hash, window, item_ids``: every distinct window, with the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    cut = items.select("item_id", "length", "words", F.explode(starts).alias("at"))
    cut = cut.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("window"))
    return cut.groupBy("length", "window").agg(F.collect_set("item_id").alias("item_ids"))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each document, and
    ``hit_words``: the covered words as sorted spans ``(start, end)``, counted from 0."""
    return keyed_contamination(documents, benchmark, n, broadcast_windows).drop("key")


def keyed_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """As ``contamination``, with ``key``, the hash of the text that each row is about."""
    known = benchmark_windows(benchmark, n)
    counts = {r["length"]: r["count"] for r in known.groupBy("length").count().collect()}  # n rows at most
    lengths, small = sorted(counts), sum(counts.values()) <= broadcast_windows
    known = hashed_windows(known, lengths)
    texts = documents.select("doc_id", "text").withColumn("words", words(F.col("text")))
    texts = texts.withColumn("key", F.xxhash64("text")).withColumn("w1", word_hashes(F.col("words")))
    texts = windows_by_length(texts.drop("text"), lengths)
    # Position -1 stands for the document itself, so that it is kept without hits and counted once.
    itself = F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.lit(0).alias("length"), F.lit(-1).alias("at")))
    texts = texts.select("doc_id", "key", "words", F.concat(itself, *[_numbered(F.col(f"h{m}"), m) for m in lengths]).alias("w"))
    rows = _broadcast_hits(texts, known) if small else _shuffled_hits(texts, known)
    by_text = rows.groupBy("doc_id", "key").agg(
        F.count("n_words").alias("times"),
        F.max("n_words").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.collect_set("item_ids").alias("found"),
    )
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    items = F.array_sort(F.array_distinct(F.flatten("found")))
    done = by_text.withColumn("covered", F.sort_array(F.array_distinct(places))).withColumn("items", items)
    done = done.select(
        "doc_id",
        "key",
        "times",
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("covered") > 0).alias("contaminated"),
        _runs(F.col("covered")).alias("hit_words"),
    )
    each = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.drop("copy", "times")


def _hit(at: Column, length: Column) -> Column:
    return F.when(at >= 0, F.struct(at.alias("start"), (at + length).alias("end")))


def _broadcast_hits(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, key, n_words, span, item_ids``: a row for each text, and one for each verified hit.

    The array of windows is a column before it is exploded, and the explosion an outer one, so that
    it isn't computed again for a filter on its size; explosion, look-up and check are then one compiled step, in which
    ``words`` stays where it is and only rows that pass are made."""
    scanned = texts.select("doc_id", "key", "words", F.explode_outer("w").alias("w")).select("doc_id", "key", "words", "w.*")
    met = scanned.join(F.broadcast(known), ["hash", "length"], "left")
    same = F.slice("words", F.col("at") + 1, F.col("length")) == F.col("window")
    n_words = F.when(F.col("at") == -1, F.size("words")).cast("long")
    return met.where((F.col("at") == -1) | same).select(
        "doc_id", "key", n_words.alias("n_words"), _hit(F.col("at"), F.col("length")).alias("span"), "item_ids"
    )


def _shuffled_hits(texts: DataFrame, known: DataFrame) -> DataFrame:
    """As ``_broadcast_hits``, by shuffle joins: hashes of windows with the set, then hits with words."""
    scanned = texts.select("doc_id", "key", F.explode_outer("w").alias("w")).select("doc_id", "key", "w.*")
    hit = F.struct("at", "length", "window", "item_ids")
    found = scanned.where("at >= 0").distinct().join(known, ["hash", "length"])
    found = found.groupBy("doc_id", "key").agg(F.collect_list(hit).alias("hits"))
    found = found.withColumnsRenamed({"doc_id": "hit_doc_id", "key": "hit_key"})
    same_text = texts["doc_id"].eqNullSafe(found["hit_doc_id"]) & texts["key"].eqNullSafe(found["hit_key"])
    whole = texts.join(found, same_text, "left").select("doc_id", "key", "words", "hits")
    real = F.filter("hits", lambda h: F.slice("words", h["at"] + 1, h["length"]) == h["window"])
    own = F.struct(F.size("words").cast("long").alias("n_words"), F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("array<string>").alias("item_ids"))
    none = F.lit(None).cast("long")
    hits = F.transform(real, lambda h: F.struct(none.alias("n_words"), h["at"].alias("at"), h["length"].alias("length"), h["item_ids"].alias("item_ids")))
    rows = whole.select("doc_id", "key", F.inline(F.concat(F.array(own), F.coalesce(hits, F.array().cast("array<struct<n_words: long, at: int, length: int, item_ids: array<string>>>")))))
    return rows.select("doc_id", "key", "n_words", _hit(F.col("at"), F.col("length")).alias("span"), "item_ids")


def _runs(places: Column) -> Column:
    """Sorted places as spans ``(start, end)``: a span starts where the place before is missing."""
    starts = F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) < p - 1, F.lit(True)))
    ends = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) > p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def _numbered(hashes: Column, length: int) -> Column:
    return F.transform(
        hashes, lambda h, i: F.struct(h.alias("hash"), F.lit(length).alias("length"), i.alias("at"))
    )


def hashed_windows(known: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds to each benchmark window the hash that the same words get in a document."""
    known = windows_by_length(known.withColumn("w1", word_hashes(F.col("window"))), lengths)
    hashes = [F.when(F.col("length") == m, F.col(f"h{m}")[0]) for m in lengths]
    hash_ = F.coalesce(*hashes) if hashes else F.lit(None).cast("long")
    return known.select("length", hash_.alias("hash"), "window", "item_ids")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents, all their columns, that hold no benchmark window; rows with equal ``doc_id``,
    or none, are kept or taken out each by its own text."""
    hits = keyed_contamination(documents, benchmark, n).where("contaminated")
    bad = hits.select(F.col("doc_id").alias("bad_doc_id"), F.col("key").alias("bad_key")).distinct()
    same = documents["doc_id"].eqNullSafe(bad["bad_doc_id"]) & (F.xxhash64(documents["text"]) == bad["bad_key"])
    return documents.join(bad, same, "left_anti")
