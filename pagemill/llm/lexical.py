"""Ranked lexical search by pipelined term partitioning.

The postings of the asked terms are dealt to term owners, the rarest terms to the first.  A bundle is
one item's sparse accumulators (document, score so far) over one block of documents.  It visits the
owners one after the other: at each stage a cogroup brings the bundles of a block together with the
postings that the stage's owner holds for that block, and the owner adds the integer contributions of
its terms.  Blocks hold at most ``BLOCK_DOCS`` documents and slices at most ``SLICE_ITEMS`` items, so no group grows
with the corpus or with the number of items, whatever the terms' frequencies are.

After each stage a bundle leaves out the documents that can't be among the best ``k``: those whose
score plus all that later owners can add is below the bundle's own k-th score so far.  That bound
holds for every document, so nothing is lost by it.  The last stage keeps ``k`` documents of each
bundle, ties by id, and a window over those chooses the answer.

A term is a run of digits, ASCII letters (A-Z made small) and non-ASCII characters of the whole text.  With N documents
that have a term, L terms in all, n in the document, df documents that hold the term and tf occurrences
in this one::

    w = floor(1000 * ln((2N + 2) / (2df + 1)))        m = 25 + (75 * n * N) div L
    score = sum over the item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 8 * m))

Defined results: null, empty and wordless texts have no term and are never found; items without terms
have no rows.  Each row of ``documents`` and of ``items`` counts for itself: rows with a repeated
``doc_id`` are ranked each, and a repeated ``item_id`` is answered as often as it occurs.  Equal
scores go to the smaller id, none last.  Documents with a score of 0 are not returned.  Other columns
are not read.  Of empty tables the result is empty.

The asked terms are broadcast while they are at most ``BROADCAST_TERMS`` (counted); beyond that all
terms are indexed and Spark joins them by shuffle, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored

BLOCK_DOCS, BLOCK_TERMS = 4_096, 4_000_000
SLICE_ITEMS = 256
BROADCAST_TERMS = 500_000
#: A term belongs to the first owner whose share of all documents its own doesn't exceed.
OWNER_SHARES = (1 / 512, 1 / 64, 1 / 8, 1.0)
MOST = 1_000_000  # no contribution is above w * MOST, as m is 25 at least

_SPACE, _UPPER = ord(" "), range(ord("A"), ord("Z") + 1)
_TERM_ASCII = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *_UPPER}
_TABLE = bytes(b + 32 if b in _UPPER else b if b in _TERM_ASCII or b > 127 else _SPACE for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = [Counter(terms_of(t)) for t in _bytes(batch.column("text"))]
        sizes = [len(c) for c in counted]
        yield pa.record_batch({
            "item": batch.column("item").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
            "term": pa.array(list(chain.from_iterable(counted)), pa.binary()),
            "times": pa.array(list(chain.from_iterable(c.values() for c in counted)), pa.int64()),
        })


class _Block:
    """Documents on their way into one block of the index."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.ids, self.sizes, self.postings, self.n_terms = id_type, [], [], {}, 0

    def add(self, doc_id, terms: list[bytes], wanted: set[bytes] | None) -> None:
        at, n = len(self.ids), len(terms)
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.n_terms += n
        for term, tf in Counter(terms if wanted is None else [t for t in terms if t in wanted]).items():
            self.postings.setdefault(term, []).append((at, tf))

    def batch(self, number: int) -> pa.RecordBatch:
        """A row with the documents' ids and sizes, and one for each term; places follow the ids, so
        that of two documents the one with the smaller id has the smaller place."""
        ids = pa.array(self.ids, self.id_type)
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        sizes = np.array(self.sizes, np.int64)
        pairs = np.array(list(chain.from_iterable(self.postings.values())), np.int64).reshape(-1, 2)
        lengths = [len(p) for p in self.postings.values()]
        offsets = np.concatenate([[0, 0], np.cumsum(lengths)]).astype(np.int32)
        rows = len(lengths) + 1
        own = np.concatenate([[0], np.full(rows, len(order))]).astype(np.int32)

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

        return pa.record_batch({
            "block": pa.array(np.full(rows, number, np.int64)),
            "term": pa.array([None, *self.postings], pa.binary()),
            "at": lists(place[pairs[:, 0]]),
            "tf": lists(pairs[:, 1]),
            "n": lists(sizes[pairs[:, 0]]),
            "ids": pa.ListArray.from_arrays(pa.array(own), ids.take(pa.array(order))),
            "docs": pa.array([int((sizes > 0).sum())] + [0] * (rows - 1), pa.int64()),
            "terms": pa.array([int(sizes.sum())] + [0] * (rows - 1), pa.int64()),
        })


def index(documents: DataFrame, wanted=None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings by block: ``block, term, at, tf, n``; the row without term holds ``ids``, the number of
    documents with a term and that of their terms.  ``wanted`` is a broadcast set of terms, or None for all."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, None
        asked = None if wanted is None else wanted.value
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text"))):
                block = block or _Block(id_type)
                block.add(doc_id, terms_of(text), asked)
                if len(block.ids) >= block_docs or block.n_terms >= BLOCK_TERMS:
                    yield block.batch((task << 32) + made)
                    made, block = made + 1, None
        if block:
            yield block.batch((task << 32) + made)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"block long, term binary, at array<int>, tf array<long>, n array<long>, ids array<{kind}>, docs long, terms long"
    return documents.select("doc_id", "text").mapInArrow(build, schema)


def weight(df: Column, n_docs: int) -> Column:
    share = F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double")
    return F.floor(F.lit(1000.0) * F.ln(share)).cast("long")


def owner(df: Column, n_docs: int) -> Column:
    return sum((df > share * n_docs).cast("int") for share in OWNER_SHARES[:-1])


def parts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``(10^9 * tf) div (1000 * tf + 8 * m)``; in integers of any length where 64 bits might not do."""
    if 75 * n_docs * int(n.max(initial=0)) >= 2**62 or int(tf.max(initial=0)) >= 2**32:
        tf, n = tf.astype(object), n.astype(object)
    m = 25 + (75 * n * n_docs) // n_terms
    return ((10**9 * tf) // (1000 * tf + 8 * m)).astype(np.int64)


def _stage(n_docs: int, n_terms: int, k: int, last: bool):
    """What a term owner does with the bundles of one block and slice."""

    def add(key, bundles: pa.Table, owned: pa.Table) -> pa.Table:
        width = 0
        for table in (bundles, owned):
            if table.num_rows:
                width = max(width, pc.max(pc.list_flatten(table["at"])).as_py() + 1)
        scores: dict[int, np.ndarray] = {}
        rest: dict[int, int] = {}
        for row in zip(*(bundles[c] for c in ("item", "at", "score"))):
            dense = scores[row[0].as_py()] = np.zeros(width, np.int64)
            dense[row[1].values.to_numpy()] = row[2].values.to_numpy()
        for row in zip(*(owned[c] for c in ("at", "tf", "n", "asked"))):
            at = row[0].values.to_numpy()
            part = parts(row[1].values.to_numpy(), row[2].values.to_numpy(), n_docs, n_terms)
            for ask in row[3].as_py():
                dense = scores.get(ask["item"])
                if dense is None:
                    dense = scores[ask["item"]] = np.zeros(width, np.int64)
                dense[at] += ask["weight"] * part
                rest[ask["item"]] = ask["rest"]
        items, ats, values = [], [], []
        for item, dense in scores.items():
            at = np.flatnonzero(dense)
            score = dense[at]
            if len(at) > k:
                if last:
                    best = np.argsort(-score, kind="stable")[:k]
                    at, score = at[best], score[best]
                elif item in rest:
                    kept = score + rest[item] >= np.partition(score, -k)[-k]
                    at, score = at[kept], score[kept]
            if len(at):
                items.append(item)
                ats.append(at.astype(np.int32))
                values.append(score)
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in ats])]).astype(np.int32)
        whole = [np.concatenate([np.empty(0, kind), *arrays]) for kind, arrays in ((np.int32, ats), (np.int64, values))]
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(items), pa.int64()),
            "slice": pa.array([key[1].as_py()] * len(items), pa.int32()),
            "item": pa.array(items, pa.int64()),
            "at": pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole[0])),
            "score": pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole[1])),
        })

    return add


BUNDLE = "block long, slice int, item long, at array<int>, score array<long>"


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    broadcast_terms: int = BROADCAST_TERMS,
    block_docs: int = BLOCK_DOCS,
    slice_items: int = SLICE_ITEMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each row of ``items``."""
    spark = documents.sparkSession
    numbered = items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    numbered = stored(numbered, "search-items")
    asked = stored(numbered.mapInArrow(_item_terms, "item long, term binary, times long"), "search-terms")
    vocabulary = asked.select("term").distinct()
    small = vocabulary.limit(broadcast_terms + 1).count() <= broadcast_terms
    wanted = spark.sparkContext.broadcast({bytes(r.term) for r in vocabulary.collect()}) if small else None
    postings = stored(index(documents, wanted, block_docs), "search-postings")
    totals = postings.where("term is null").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = totals.docs or 0, totals.terms or 0

    frequency = postings.where("term is not null").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    known = frequency.select("term", weight(F.col("df"), n_docs).alias("w"), owner(F.col("df"), n_docs).alias("owner"))
    asks = asked.join(known, "term").withColumn("weight", F.col("times") * F.col("w"))
    # What the owners after this one can still add to the item.
    later = Window.partitionBy("item").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, -1)
    rest = F.coalesce(F.sum("weight").over(later), F.lit(0)) * MOST
    slices = max(1, -(-numbered.count() // slice_items))
    sliced = F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")
    asks = asks.withColumn("rest", rest).withColumn("slice", sliced)
    ask = F.struct("item", "weight", "rest")
    by_term = stored(asks.groupBy("owner", "slice", "term").agg(F.collect_list(ask).alias("asked")), "search-asks")

    bundles = spark.createDataFrame([], BUNDLE)
    rows = postings.where("term is not null").select("block", "term", "at", "tf", "n")
    for stage in range(len(OWNER_SHARES)):
        of_owner = by_term.where(F.col("owner") == stage).drop("owner")
        owned = rows.join(F.broadcast(of_owner) if small else of_owner, "term").drop("term")
        last = stage == len(OWNER_SHARES) - 1
        bundles = (
            bundles.groupBy("block", "slice")
            .cogroup(owned.groupBy("block", "slice"))
            .applyInArrow(_stage(n_docs, n_terms, k, last), BUNDLE)
        )
    ids = postings.where("term is null").select("block", "ids")
    hits = bundles.join(ids, "block").select("item", F.inline(F.transform(
        F.arrays_zip("at", "score"),
        lambda h: F.struct(F.get("ids", h["at"]).alias("doc_id"), h["score"].alias("score")),
    )))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    answer = stored(ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "search")
    discard(postings, by_term, asked, numbered)
    if wanted is not None:
        wanted.destroy()
    return answer
