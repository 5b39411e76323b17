"""Exact dedup by composable polynomial fingerprints.

Texts are equal when they are identical after each run of white space (``[\\x20\\x09-\\x0D]+``) is
replaced by one space.  The fingerprint of a string of bytes s with n bytes is its length and, for
three primes p below 2^31, ``sum(s[i] * B^(n-1-i)) mod p``.  It composes: that of ``a`` followed by
``b`` is ``f(a) * B^|b| + f(b)``.  So a text of more than ``PIECE`` bytes is cut into pieces that any task
can hash, and the pieces' hashes are put together by length-shifted sums in Spark; shorter texts are
one piece and need no shuffle.

Equal fingerprints only say which texts to compare.  The row with the smallest ``doc_id`` stands for
its group; the texts of groups of two or more are compared with it piece by piece, as a join of
pieces that streams through them, so no task holds a text of many pieces or a group.  Rows that differ
from it form new groups by the first piece that differs, and are compared again until none does.

A group may hold a third of all rows: its members are dealt to as many parts as their number asks for
(``PART_ROWS``), and only the pieces of the one row that stands for the group are there once for each.

Defined results: null counts as empty, and empty texts equal one another.  Texts are whole.  Rows with
equal ``doc_id`` count each; of equal texts under the smallest id one row stays.  Rows without id come after
all others, so one of them stays only where no row has an id; ``keep_id`` is then null.  An
empty table gives an empty result.  Other columns are not read by ``duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import discard, stored

PIECE = 1 << 18  # bytes; times 255 and a prime below 2^31 its sums stay far below 2^63
PART_ROWS = 256
BROADCAST_GROUPS = 1_000_000
# The three largest primes below 2^31, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_299_709_337, 982_451_653, 1_600_000_871)


def normalised(text: Column) -> Column:
    """Matches only the runs that change, which are few."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """``base^(n-1) ... base^0`` mod prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out * pow(base, len(out), prime) % prime, out])
    return out[len(out) - n :]


def piece_hasher(primes: tuple[int, ...], bases: tuple[int, ...], piece: int):
    """``hashes, shifts`` of binary pieces: a polynomial for each prime, and the base to the power of the
    piece's length, by which the hash of all that comes before is multiplied."""

    @F.pandas_udf("hashes array<long>, shifts array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = [_powers(p, b, piece + 1) for p, b in zip(primes, bases)]
        for pieces in batches:
            hashes, shifts = [], []
            for data in pieces:
                values = np.frombuffer(data, np.uint8).astype(np.int64)
                n = len(values)
                hashes.append([int(values @ t[len(t) - n :]) % p if n else 0 for t, p in zip(tables, primes)])
                shifts.append([int(t[len(t) - 1 - n]) for t in tables])
            yield pd.DataFrame({"hashes": hashes, "shifts": shifts})

    return hashed


def composed(pieces: Column, primes: tuple[int, ...] = PRIMES) -> Column:
    """One hash for each prime from ``array<struct<.., hashes, shifts>>`` in order of the pieces."""
    moduli = F.array(*[F.lit(p) for p in primes])

    def join(done: Column, piece: Column) -> Column:
        shifted = F.zip_with(done, piece["shifts"], lambda a, b: a * b)
        summed = F.zip_with(shifted, piece["hashes"], lambda a, b: a + b)
        return F.zip_with(summed, moduli, lambda a, p: a % p)

    return F.aggregate(pieces, F.array(*[F.lit(0).cast("long")] * len(primes)), join)


def _cut(text: Column, piece: int) -> Column:
    """``no, piece`` of the text's bytes; an empty text is one empty piece."""
    data = text.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(text) / piece), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.alias("no"), F.substring(data, i * piece + 1, F.lit(piece)).alias("piece")),
    )


def _short(documents: DataFrame, hashed, piece: int) -> DataFrame:
    """``doc_id, text, text_sha256, fp`` of texts of one piece, in one pass over them."""
    rows = documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= piece)
    rows = rows.select("doc_id", normalised(F.col("text")).alias("text"))
    data = F.col("text").cast("binary")
    rows = rows.select("doc_id", data.alias("text"), F.sha2(data, 256).alias("text_sha256"), hashed(data).alias("h"))
    fp = F.concat_ws(":", F.octet_length("text").cast("string"), F.col("h.hashes").cast("array<string>"))
    return rows.select("doc_id", "text", "text_sha256", fp.alias("fp"))


def _long(documents: DataFrame, hashed, piece: int) -> DataFrame:
    """``row, doc_id, text_sha256, size, no, piece, h`` of all pieces of longer texts."""
    rows = documents.where(F.octet_length("text") > piece)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", normalised(F.col("text")).alias("text"))
    sha, size = F.sha2(F.col("text").cast("binary"), 256), F.octet_length("text")
    cut = rows.select("row", "doc_id", sha.alias("text_sha256"), size.alias("size"), F.inline(_cut(F.col("text"), piece)))
    return cut.repartition("row", "no").withColumn("h", hashed("piece"))


def _composed_long(pieces: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """``row, doc_id, text_sha256, fp`` of texts of several pieces, put together from their hashes."""
    piece = F.struct("no", F.col("h.hashes").alias("hashes"), F.col("h.shifts").alias("shifts"))
    whole = pieces.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "text_sha256", "size")],
        F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    hashes = composed(F.col("pieces"), primes).cast("array<string>")
    return whole.select("row", "doc_id", "text_sha256", F.concat_ws(":", F.col("size").cast("string"), hashes).alias("fp"))


def _with_group(rows: DataFrame, groups: DataFrame, key: str, small: bool) -> DataFrame:
    """Many rows for a group on the left, one on the right."""
    return rows.join(F.broadcast(groups), key) if small else salted_join(rows, groups, key, "inner")


def _heads(texts: DataFrame) -> DataFrame:
    """``grp, rows, head, keep_id``: the row that stands for a group has the smallest id, none last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = texts.where("no = 0").groupBy("grp").agg(F.count("*").alias("rows"), F.min(order).alias("first"))
    return first.select("grp", "rows", F.col("first.row").alias("head"), F.col("first.doc_id").alias("keep_id"))


def _differing(tagged: DataFrame) -> DataFrame:
    """``row, at``: the first piece in which a row isn't what its group's head is."""
    parts = F.ceil(F.col("rows") / PART_ROWS).cast("int")
    mine = tagged.where("row <> head").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    theirs = tagged.where("row = head").select(
        "grp", "no", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("piece").alias("head_piece")
    )
    met = mine.select("row", "grp", "part", "no", "piece").join(theirs, ["grp", "part", "no"], "left")
    other = met.where(~F.col("piece").eqNullSafe(F.col("head_piece")))
    return other.groupBy("row").agg(F.min(F.struct("no", F.sha2("piece", 256).alias("digest"))).alias("at"))


def duplicates(
    documents: DataFrame,
    piece: int = PIECE,
    primes: tuple[int, ...] = PRIMES,
    bases: tuple[int, ...] = BASES,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row.

    Two passes: the first keeps fingerprints alone, the second the texts of fingerprints that occur
    twice or more.  The groups' heads are broadcast while they are at most ``broadcast_groups``
    (counted); beyond that they are joined by shuffle, heavy groups in parts.
    """
    hashed = piece_hasher(primes, bases, piece)
    short = _short(documents, hashed, piece)
    long_ = stored(_long(documents, hashed, piece), "exact-long")
    whole = _composed_long(long_, primes)
    marked = stored(short.drop("text").unionByName(whole.drop("row")), "exact-fingerprints")

    groups = marked.groupBy("fp").agg(F.count("*").alias("rows")).where("rows > 1").select("fp", F.col("fp").alias("grp"))
    groups = stored(groups, "exact-groups")
    small = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    # From here on a row is known by a number, which is stored with it.
    of_short = _with_group(short, groups, "fp", small).select(
        (2 * F.monotonically_increasing_id()).alias("row"), "doc_id", "text_sha256", "grp",
        F.lit(0).alias("no"), F.col("text").alias("piece"),
    )
    of_long = _with_group(whole.select("row", "fp"), groups, "fp", small).drop("fp").join(long_, "row").select(
        (2 * F.col("row") + 1).alias("row"), "doc_id", "text_sha256", "grp", "no", "piece"
    )
    texts = stored(of_short.unionByName(of_long), "exact-texts")
    done, used, open_ = [], [long_, marked, groups, texts], texts
    while True:
        heads = stored(_heads(open_), "exact-heads")
        tagged = _with_group(open_, heads, "grp", small)
        off = stored(_differing(tagged), "exact-differing")
        used += [heads, off]
        rows, settled = tagged.where("no = 0").drop("piece", "no"), off.isEmpty()
        if not settled:
            rows = rows.join(off, "row", "left_anti").drop("rows")
            sizes = rows.groupBy("grp").agg(F.count("*").alias("rows"))
            rows = _with_group(rows, sizes, "grp", small)
        done.append(rows.select(
            "doc_id", "keep_id", F.col("rows").alias("group_size"), (F.col("row") == F.col("head")).alias("kept"), "text_sha256"
        ))
        if settled:
            break
        again = F.sha2(F.concat_ws("/", "grp", F.col("at.no").cast("string"), "at.digest"), 256)
        open_ = stored(open_.join(off, "row").withColumn("grp", again).drop("at"), "exact-open")
        used.append(open_)
    alone = marked.join(groups.select("fp"), "fp", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    for rows in done:
        alone = alone.unionByName(rows)
    answer = stored(alone, "exact")
    discard(*used)
    return answer


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all its columns: a row under the group's ``keep_id``, the
    least by hash of its columns where that id repeats."""
    stay = duplicates(documents).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(normalised(documents["text"]).cast("binary"), 256)
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), "doc_id", sha.alias("_text"))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["_id"]) & (F.col("_text") == F.col("_sha")), "left_semi")
    kept = rows.groupBy("doc_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.select("_row.*")
