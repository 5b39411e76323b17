"""Near copies by SimHash, with pivot distance tables.

A fingerprint has a bit set if more than half of the document's shingle hashes have it set.  Links
join fingerprints that differ in at most three bits.  Work is done on distinct fingerprints:

* Candidates: the 64 bits are five blocks.  Three differing bits leave two blocks untouched, so
  linked fingerprints agree on both blocks of at least one of the ten pairs of blocks.
* Pivots: in a group that agrees on two blocks, every fingerprint has a row of Hamming distances to
  ``PIVOTS`` reference fingerprints.  By the triangle inequality, two whose distances to any one
  reference differ by more than three can't be linked.  Rows are sorted by the first distance, so
  that only a short stretch is looked at; the other columns of the table discard most of it; what
  survives is verified bit by bit.
* A group of more than ``GROUP_ROWS`` is split again: the bits in which its fingerprints differ at all
  are dealt into four parts, and three differing bits leave one of them untouched, so linked
  fingerprints meet again in one of the four groupings by a part.  Every level has fewer such bits,
  so groups end below ``GROUP_ROWS`` without a pair being lost, and no task holds a large group.  A
  group gives at most one link for each row, to the smallest fingerprint that it is connected with
  there: as good for components as all its pairs.

Components come from ``components``; their id is the smallest doc_id of all their documents.

Defined results: a null text is empty.  A text with fewer words than a shingle is one shingle; one
without words has fingerprint zero and is linked like any other.  Equal texts, and rows with equal
doc_id, are each returned.  Rows without doc_id take part; a component with no doc_id at all has a
null id.  Whole texts are read; only ``doc_id`` and ``text`` of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components

SHINGLE, SEED, BITS, APART = 3, 42, 64, 3
BLOCKS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
PIVOTS = 16
GROUP_ROWS = 256
HASHED_AT_ONCE = 1 << 15
STRETCH_ROWS = 1 << 15


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: zero, then hashes of 1, 2, 3, ..."""
    return np.array([0, *(xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(1, n))], dtype=np.uint64)


def hashed_shingles(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles in order, some at a time; none of a text without words."""
    words = text.lower().split()  # of bytes: A-Z, and white space 09-0D and 20
    if not words:
        return
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    hash_ = xxhash.xxh64_intdigest
    for start in range(0, total, HASHED_AT_ONCE):
        n = min(HASHED_AT_ONCE, total - start)
        yield np.fromiter((hash_(s, SEED) for _, s in zip(range(n), shingles, strict=False)), np.uint64, n)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    return of_hashes(hashed_shingles(text, shingle))


def of_hashes(chunks: Iterable[np.ndarray]) -> int:
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    set_ = np.packbits(2 * counts > total, bitorder="little")
    return int(set_.view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        prints = [simhash((t.as_py() or "").encode()) for t in texts]
        return pa.array(np.array(prints, dtype=np.uint64).view(np.int64))

    return run.asNondeterministic()(text)


def near_copies(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``."""
    prints = stored(documents.select("doc_id", fingerprint(F.col("text")).alias("bits")), "prints")
    firsts = prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    links = close_pairs(firsts.select("bits"))
    roots = connected_components(links.select(F.col("bits").alias("a"), F.col("root").alias("b")))
    roots = roots.select(F.col("node").alias("bits"), "root")
    # Roots are part of their component; fingerprints without links are not in this table.
    member = roots.unionByName(roots.select(F.col("root").alias("bits"), "root").distinct())
    linked = stored(member.join(firsts, "bits"), "members")
    ids = stored(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    of_linked = linked.join(ids, "root").select("bits", "component_id")
    alone = firsts.join(member.select("bits"), "bits", "left_anti")
    ids_of = stored(of_linked.unionByName(alone.select("bits", F.col("first_id").alias("component_id"))), "components")
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return prints.join(ids_of, "bits").select("doc_id", hexed.alias("fingerprint"), "component_id")


def close_pairs(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``bits, root``: links among distinct fingerprints, with the components of all close pairs.

    ``group_rows`` is at least 8: so many fingerprints differ in four bits or more.
    """
    bits = F.col("bits")
    keys = []
    for pair in combinations(BLOCKS, 2):
        mask = sum(((1 << high) - 1) ^ ((1 << low) - 1) for low, high in pair)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(bits.bitwiseAND(F.lit(signed)))
    met = prints.select("bits", F.posexplode(F.array(*keys)).alias("band", "key"))
    met = met.select("bits", F.xxhash64("band", "key").alias("crowd"))
    small = []
    while True:
        # Crowds are told apart by a hash; two with the same one would be compared in vain, no more.
        apart = F.bit_or("bits").bitwiseXOR(F.bit_and("bits"))
        crowds = met.groupBy("crowd").agg(F.count("*").alias("n"), apart.alias("apart")).where("n > 1")
        crowds = crowds.select("crowd", F.when(F.col("n") > group_rows, _parts(F.col("apart"))).alias("parts"))
        met = stored(met.join(crowds, "crowd"), "crowds")
        small.append(met.where("parts is null").select("crowd", "bits"))
        large = met.where("parts is not null")
        if large.isEmpty():
            break
        split = large.select("crowd", "bits", F.posexplode("parts").alias("part", "mask"))
        met = split.select("bits", F.xxhash64("crowd", "part", bits.bitwiseAND(F.col("mask"))).alias("crowd"))
    dealt = reduce(DataFrame.unionByName, small).repartition("crowd").sortWithinPartitions("crowd")
    return dealt.mapInArrow(_linked_units, "bits long, root long")


def _parts(mask: Column) -> Column:
    """The set bits of a mask dealt into as many masks as leave one without a differing bit."""
    places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda at: F.getbit(mask, at) == 1)
    ones = F.transform(places, lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at))

    def part(n: int) -> Column:
        own = F.filter(ones, lambda one, at: F.pmod(at, F.lit(APART + 1)) == n)
        return F.aggregate(own, F.lit(0).cast("long"), lambda all_, one: all_.bitwiseOR(one))

    return F.array(*(part(n) for n in range(APART + 1)))


def _linked_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole crowds, so that a crowd is never cut."""
    kept: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        table = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("crowd", "bits")])
        kept.append(table)
        rows += len(table)
        if rows >= STRETCH_ROWS:
            table = np.concatenate(kept)
            starts = _starts(table)
            cut = starts[-1] if len(starts) else 0
            if cut:
                yield _links(table[:cut])
            kept, rows = [table[cut:]], len(table) - cut
    if rows:
        yield _links(np.concatenate(kept))


def _starts(table: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1


def _links(table: np.ndarray) -> pa.RecordBatch:
    unit = np.zeros(len(table), np.int64)
    unit[_starts(table)] = 1
    unit = np.cumsum(unit)
    prints = np.ascontiguousarray(table[:, 1]).view(np.uint64)
    pivots = np.bitwise_count(prints[:, None] ^ references()[None, :]).astype(np.int8)
    order = np.lexsort((prints, pivots[:, 0], unit))
    unit, prints, pivots = unit[order], prints[order], pivots[order]
    root = linked_roots(unit, prints, pivots)
    signed = prints.view(np.int64)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], names=["bits", "root"])


def linked_roots(unit: np.ndarray, prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row the first row of its unit that it is connected with, rows in order of unit and
    of the distance to the first reference."""
    root = np.arange(len(prints))
    left = np.arange(len(prints))
    for shift in range(1, len(prints)):
        left = left[left + shift < len(prints)]
        right = left + shift
        # Sorted by the first distance: once too far apart, all later rows are.
        near = (unit[left] == unit[right]) & (pivots[right, 0] - pivots[left, 0] <= APART)
        left = left[near]
        if not len(left):
            break
        a, b = left, left + shift
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        for p in range(1, pivots.shape[1]):
            if not len(a):
                break
            small = np.abs(pivots[a, p] - pivots[b, p]) <= APART
            a, b = a[small], b[small]
        if len(a):
            close = np.bitwise_count(prints[a] ^ prints[b]) <= APART
            _unite(root, a[close], b[close])
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b; roots stay the smallest rows, trees stay flat."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, further := root[root]):
            root[:] = further
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, with one of each component: that with the smallest doc_id,
    or none if there is no other, and of those with the smallest hash of its text.  Components are
    told apart by their fingerprints, so rows without doc_id or with one that repeats stay by text."""
    prints = stored(documents.select("doc_id", text_key().alias("key"), fingerprint(F.col("text")).alias("bits")), "prints")
    firsts = stored(prints.groupBy("bits").agg(F.min(order()).alias("first")), "firsts")
    links = close_pairs(firsts.select("bits"))
    roots = connected_components(links.select(F.col("bits").alias("a"), F.col("root").alias("b")))
    return firsts_only(documents, firsts, roots.withColumnRenamed("node", "bits"), "bits")


def text_key() -> Column:
    return F.xxhash64("text")


def order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")


def firsts_only(documents: DataFrame, firsts: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """The documents that come first in their components, from the first of each node; ``roots`` has
    the nodes that aren't roots themselves."""
    rooted = firsts.join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    keep = stored(keep.toDF("kept_id", "kept_key"), "kept")
    keyed = documents.withColumn("_text_key", text_key())
    same = keyed["doc_id"].eqNullSafe(keep["kept_id"]) & (keyed["_text_key"] == keep["kept_key"])
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
