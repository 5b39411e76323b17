"""Exact top-k inner products by block-at-a-time pruning.

Vectors are made integers, component by component, as ``floor(scale * x)``.  A task puts the
vectors of an Arrow batch in an order that brings similar ones together and cuts it into blocks;
a block is a small forward index (its rows as a matrix) and holds the largest and the smallest
value of every component.  For each query the sum of the best possible terms bounds the scores of a
block.  A query visits the blocks from the highest bound down and stops when the next bound is
below the score of its k-th hit so far.  Nothing is estimated: ties and bounds are integers.

The queries are a stated set against all rows.  They are dealt by a hash of their id into slices of
about ``slice_rows``, and one slice at a time is broadcast (``slice_rows * dimensions * 8`` bytes): its
hits are written and the broadcast is destroyed before the next, so that what is broadcast doesn't
grow with the table and the plan has one scan of hits however many slices there are.  A first look at ``seed_rows`` candidates
gives every query a k-th score to begin with; it only saves work.

Defined results: rows whose vector is null or holds null, NaN or infinity, and rows without id, take
no part.  Rows with the query's id are its own and never its hits; a repeated id in other rows
counts each time.  Each query row is answered, repeated ones too.  A vector that is shorter than
another counts as padded with zeros.  Equal scores go to the smaller id.  Components beyond 64 bits
saturate; scores that 53 bits can't hold are computed with integers of any length and saturate at
64 bits.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder

BLOCK_ROWS = 256
SLICE_ROWS = 16_384
SEED_ROWS = 2_048
HITS = "query_no long, query_id long, vec_id long, score long"


def whole_components(vector: Column, scale: int) -> Column:
    """The vector as integers; null where it takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when(vector.isNotNull() & ~bad, ints)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for every query.

    Both tables have ``vec_id`` and ``embedding``; other columns are not read.
    """
    spark = vectors.sparkSession
    candidates = _prepared(vectors, scale)
    asked = _prepared(queries, scale)
    slices = max(1, -(-asked.count() // slice_rows))
    seed = _matrix(candidates.limit(SEED_ROWS).toArrow())
    folder = new_folder(spark, "hits")
    for n in range(slices):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == n)
        ids, rows = _matrix(mine.toArrow())
        first = Search(ids, rows, k)
        first.scan(*seed)
        floor = first.kth()
        sent = spark.sparkContext.broadcast((n * 2**32, ids, rows, floor, k))
        candidates.mapInArrow(_searched(sent), HITS).write.mode("append").parquet(folder)
        sent.destroy()
    found = spark.read.schema(HITS).parquet(folder)
    best = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _prepared(vectors: DataFrame, scale: int) -> DataFrame:
    ints = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        whole_components(F.col("embedding"), scale).alias("ints"),
    )
    return ints.where("vec_id is not null and ints is not null")


def _searched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids, rows, floor, k = sent.value
        search = Search(ids, rows, k, floor)
        for batch in batches:
            search.scan(*_matrix(batch))
        query, score, vec = search.hits()
        yield pa.RecordBatch.from_arrays(
            [pa.array(base + query), pa.array(ids[query]), pa.array(vec), pa.array(score)],
            names=["query_no", "query_id", "vec_id", "score"],
        )

    return run


def _matrix(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and one row of integers for each vector, padded with zeros."""
    ids, lists = table.column("vec_id"), table.column("ints")
    if isinstance(table, pa.Table):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    ids = np.asarray(ids, dtype=np.int64)
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(ids), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return ids, out


class Search:
    """The hits of a set of queries among the candidates seen so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.rows, self.k = ids, rows, k
        self.floor = np.full(len(ids), np.iinfo(np.int64).min) if floor is None else floor.copy()
        none = np.zeros(0, np.int64)
        self.pool = (none, none, none)

    def kth(self) -> np.ndarray:
        return self.floor

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, score and id of the hits."""
        return self.pool

    def scan(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in more candidates, block by block."""
        if not len(ids) or not len(self.ids):
            return
        width = max(rows.shape[1], self.rows.shape[1])
        queries, rows = _wide(self.rows, width), _wide(rows, width)
        most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (queries, rows)]
        kind = np.float64 if most[0] * most[1] * max(width, 1) < 2**53 else object
        order = _near_order(rows)
        ids, rows, queries = ids[order], rows[order].astype(kind), queries.astype(kind)
        starts = np.arange(0, len(ids), BLOCK_ROWS)
        if not width:
            bounds = np.zeros((len(queries), len(starts)), np.int64)
        else:
            upper = np.array([rows[s : s + BLOCK_ROWS].max(axis=0) for s in starts], dtype=kind)
            lower = np.array([rows[s : s + BLOCK_ROWS].min(axis=0) for s in starts], dtype=kind)
            up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
            bounds = _whole(up.dot(upper.T) + down.dot(lower.T))
        visits = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable")
        alive = np.arange(len(queries))
        for step in range(len(starts)):
            block = visits[alive, step]
            going = bounds[alive, block] >= self.floor[alive]
            # The order by rounded bounds is that of the bounds, so later blocks are no better.
            alive, block = alive[going], block[going]
            if not len(alive):
                break
            fresh = []
            for b in np.unique(block):
                who = alive[block == b]
                span = slice(starts[b], starts[b] + BLOCK_ROWS)
                scores = _whole(queries[who].dot(rows[span].T)) if width else np.zeros((len(who), len(ids[span])), np.int64)
                keep = (scores >= self.floor[who, None]) & (ids[span] != self.ids[who, None])
                q, c = np.nonzero(keep)
                fresh.append((who[q], scores[q, c], ids[span][c]))
            self._merge(fresh)

    def _merge(self, fresh) -> None:
        query, score, vec = (np.concatenate(x) for x in zip(self.pool, *fresh, strict=True))
        order = np.lexsort((vec, _descending(score), query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = rank < self.k
        self.pool = (query[keep], score[keep], vec[keep])


def _descending(score: np.ndarray) -> np.ndarray:
    return ~score  # -1 - score: no overflow


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _whole(scores: np.ndarray) -> np.ndarray:
    """Sums as 64-bit integers; those beyond saturate."""
    if scores.dtype == object:
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        scores = np.minimum(np.maximum(scores, low), high)
    return scores.astype(np.int64)


def _near_order(rows: np.ndarray) -> np.ndarray:
    """Rows with the same two leading components stand together, so that block maxima are tight."""
    if rows.shape[1] < 2:
        return np.lexsort(rows.T) if rows.shape[1] else np.arange(len(rows))
    lead = np.argpartition(-rows, 1, axis=1)[:, :2]
    lead.sort(axis=1)
    return np.lexsort((lead[:, 1], lead[:, 0]))
