"""Removes long byte strings that occur more than once, by sorting suffixes.

A window is a string of ``LENGTH`` bytes.  A byte goes if a window over it also starts elsewhere.
Sorting the suffix at every byte would ship each text some hundred times over, so:

1. Sampled suffixes.  The anchor of a window is the leftmost of its k-mers with the smallest hash;
   equal windows have the same anchor at the same distance.  Consecutive windows share an anchor, so
   there is one for some ninety bytes.  An anchor whose k-mer occurs once has no repeated window.
2. Of anchors with a common k-mer, those whose stretches (all their windows together) have equal
   128-bit fingerprints are repeats as a whole.  What is left lies at the ends of repeats.
3. There a stretch is cut into cells of ``CELL`` windows by distance from the anchor.  Cells with
   equal fingerprints repeat as a whole; cells that share not even the bytes common to all of their
   windows don't repeat.
4. The windows of cells in between are sorted as suffixes, by the front-coded merge sort of
   ``suffix_sort``; a window repeats if it equals its neighbour.

Texts are shuffled twice, once to cut out the stretches that step 3 needs and once to take the spans
out; everything else is narrow.  Equal fingerprints are summed by task before the shuffle, and both
sides of joins on them are tables, so adaptive execution can split a string that is in very many
documents.

Defined results: null texts are empty.  Texts shorter than a window keep all.  Equal rows are repeats
of each other, with or without equal doc_id.  Every occurrence is removed, the first too.  Whatever
the length of a text, all of it is read.  As text, bytes that are part of a character cut by a span
are dropped.  An empty table gives an empty result; other columns are kept or not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .suffix_sort import repeated, sampled_boundaries

LENGTH = 200
KMER = 48
CELL = 8
PIECE_BYTES = 1 << 20
SAMPLE_ROWS = 4096
U64 = np.uint64
PLACES = (1 << 24) - 1
ANCHORS = "doc_id long, tie long, first long, more int, at int, kmer long, whole long"
CONTEXTS = "doc_id long, tie long, first long, more int, at int, single boolean, body binary"
CELLS = "id long, single boolean, nearest int, core long, full long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out)


BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, twice, and powers of the base and of its inverse."""
    random = np.random.default_rng(200)
    n = PIECE_BYTES * 2 + 4 * LENGTH
    values = random.integers(0, 2**64, (2, 256), dtype=U64)
    return values[0], values[1], _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def kmer_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``KMER`` bytes from each place, by doubling."""
    power = lambda n: U64(pow(BASE, n, 2**64))
    h = _tables()[0][raw]
    sums = {1: h}
    size = 1
    while size * 2 <= KMER:
        h = sums[size]
        sums[size * 2] = h[:-size] * power(size) + h[size:]
        size *= 2
    done, out = size, sums[size]
    for part in (p for p in sorted(sums, reverse=True) if p < size and (KMER - size) & p):
        rest = sums[part][done:]
        out = out[: len(rest)] * power(part) + rest
        done += part
    return mixed(out)


def sliding_smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` keys from each place: two running minima over blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    grid = np.full(blocks * width, np.iinfo(U64).max, U64)
    grid[: len(keys)] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Sums:
    """Fingerprints of any substrings of some bytes."""

    def __init__(self, raw: np.ndarray):
        values = _tables()[1][raw] * _tables()[2][: len(raw)]
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        plain = (self.sums[end] - self.sums[start]) * _tables()[3][start]
        return mixed(plain ^ mixed(salt.astype(U64) + U64(1))).view(np.int64)


def anchors(pieces: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Anchors of the windows in pieces (row, place in the text, bytes)."""
    sizes = np.array([len(p[2]) for p in pieces])
    raw = np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8)
    hashes = kmer_hashes(raw)
    keys = (hashes & ~U64(PLACES)) | np.arange(len(hashes), dtype=U64)
    nearest = (sliding_smallest(keys, LENGTH - KMER + 1) & U64(PLACES)).astype(np.int64)
    ends = np.cumsum(sizes)
    windows = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    starts = np.arange(len(piece)) + np.repeat(np.arange(len(pieces)) * (LENGTH - 1), windows)
    nearest = nearest[starts]
    new = np.flatnonzero(np.concatenate([[True], (nearest[1:] != nearest[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    first, last, at = starts[new], starts[last], nearest[new]
    begin = (ends - sizes)[piece[new]]
    base = np.array([p[1] for p in pieces])[piece[new]]
    salt = (at - first) * 1024 + (last - first)
    return {
        "row": np.array([p[0] for p in pieces])[piece[new]],
        "first": first - begin + base,
        "more": (last - first).astype(np.int32),
        "at": (at - first).astype(np.int32),
        "kmer": hashes[at].view(np.int64),
        "whole": Sums(raw).of(first, last + LENGTH, salt),
    }


def text_pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in groups of about ``PIECE_BYTES``; a longer one in pieces that overlap by a window."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + LENGTH - 1]
            if size + len(piece) > 2 * PIECE_BYTES and group:
                yield group
                group, size = [], 0
            group.append((row, at, piece))
            size += len(piece)
            if size >= PIECE_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["first", "more", "at", "kmer", "whole"]
    for batch in batches:
        texts = [t.as_py() for t in batch.column("body")]
        for group in text_pieces(texts):
            found = anchors(group)
            places = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(places), batch.column("tie").take(places), *(pa.array(found[c]) for c in names)],
                names=["doc_id", "tie", *names],
            )


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of the anchors that are asked for."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            text = one.column("body")[0].as_py()
            asked = one.column("asked").flatten()
            first, more = asked.field("first").to_numpy(), asked.field("more").to_numpy()
            bodies = [text[a : a + m + LENGTH] for a, m in zip(first.tolist(), more.tolist(), strict=True)]
            same = pa.array(np.zeros(len(bodies), np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    one.column("doc_id").take(same),
                    one.column("tie").take(same),
                    *(asked.field(c) for c in ("first", "more", "at", "single")),
                    pa.array(bodies, pa.binary()),
                ],
                names=["doc_id", "tie", "first", "more", "at", "single", "body"],
            )


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            some = batch.slice(start, 2000)
            at, more = (np.asarray(some.column(c)).astype(np.int64) for c in ("at", "more"))
            bodies = some.column("body").to_pylist()
            begin = np.cumsum([0, *map(len, bodies)])[:-1]
            sums = Sums(np.frombuffer(b"".join(bodies), np.uint8))
            # A window's distance to the anchor is at - more for the last and at for the first.
            low = (at - more) // CELL
            count = at // CELL - low + 1
            row = np.repeat(np.arange(len(at)), count)
            cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
            near = np.maximum(cell * CELL, (at - more)[row])
            far = np.minimum(cell * CELL + CELL - 1, at[row])
            here = begin[row] + at[row]
            core = sums.of(here - cell * CELL, here - (cell * CELL + CELL - 1) + LENGTH, cell)
            full = sums.of(here - far, here - near + LENGTH, near * 1024 + far)
            places = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(some.column(c).take(places) for c in ("id", "single")),
                    pa.array(near.astype(np.int32)),
                    pa.array(core),
                    pa.array(full),
                ],
                names=["id", "single", "nearest", "core", "full"],
            )


def _cell_windows(batch: pa.RecordBatch):
    """The windows of the cells that are asked for, as suffixes to sort."""
    for row in batch.to_pylist():
        body, at = row["body"], row["at"]
        for cell in row["cells"]:
            near = cell["nearest"]
            for back in range(near, min(near // CELL * CELL + CELL - 1, at) + 1):
                start = at - back
                place = row["first"] + start if row["single"] else -1
                yield body[start : start + LENGTH], row["doc_id"], row["tie"], place


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id, tie, body``: rows with equal doc_id are told apart by a hash of the text."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("body"))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, tie, spans``: for texts with repeats, (first, last) starts of repeated windows."""
    texts = keyed(documents)
    long_ = texts.where(F.octet_length("body") >= LENGTH)
    found = stored(long_.mapInArrow(_anchor_rows, ANCHORS), "anchors")
    twice = stored(found.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1").select("kmer"), "kmers")
    met = found.join(twice, "kmer").withColumn("id", F.monotonically_increasing_id())
    met = stored(met, "met")  # from here on the ids are fixed
    discard(found, twice)
    # One anchor stands for all with an equal stretch.
    wholes = met.groupBy("kmer", "whole").agg(F.count("*").alias("n"), F.min("id").alias("stands"))
    wholes = stored(wholes, "wholes")
    mixed_ = wholes.groupBy("kmer").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles"))
    mixed_ = stored(mixed_.where("kinds > 1 and singles > 0").select("kmer", F.lit(True).alias("mixed")), "mixed")
    status = stored(wholes.join(mixed_, "kmer", "left").where("n > 1 or mixed"), "status")
    status = status.select("kmer", "whole", "n", "stands", "mixed")
    met_ = stored(met.join(status, ["kmer", "whole"]).drop("kmer", "whole"), "judged")
    discard(met, wholes, mixed_, status)
    as_whole = met_.where("n > 1").select(
        "doc_id", "tie", F.struct("first", (F.col("first") + F.col("more")).alias("last")).alias("span")
    )

    asked = met_.where("mixed and id = stands").withColumn("single", F.col("n") == 1)
    asked = asked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "more", "at", "single")).alias("asked"))
    wanted = long_.join(asked, same_document(long_, asked)).select(asked["doc_id"], asked["tie"], "body", "asked")
    contexts = wanted.mapInArrow(_context_rows, CONTEXTS).withColumn("id", F.monotonically_increasing_id())
    contexts = stored(contexts, "contexts")

    cells = contexts.select("id", "more", "at", "single", "body").mapInArrow(_cell_rows, CELLS)
    fulls = cells.groupBy("core", "full").agg(
        F.count("*").alias("n"), F.min("id").alias("stands"), F.max("single").alias("single")
    )
    fulls = stored(fulls, "fulls")
    cores = fulls.groupBy("core").agg(F.count("*").alias("kinds"), F.count_if((F.col("n") == 1) & F.col("single")).alias("open"))
    cores = stored(cores.where("kinds > 1 and open > 0").select("core", F.lit(True).alias("open")), "cores")
    decided = stored(fulls.join(cores, "core", "left").where("(n > 1 and single) or open"), "decided")
    known = cells.join(decided.select("core", "full", "n", "stands", "open"), ["core", "full"]).drop("core", "full")
    known = stored(known, "cells")
    discard(fulls, cores, decided)
    by_id = known.groupBy("id").agg(F.collect_list(F.struct("nearest", "n", "open", "stands")).alias("cells"))
    told = stored(contexts.join(by_id, "id"), "told")
    discard(contexts, known)
    whole_cells = told.where("single").select("doc_id", "tie", "first", "at", F.explode(F.filter("cells", lambda c: c["n"] > 1)).alias("c"))
    nearest = F.col("c.nearest")
    farthest = F.least(F.floor(nearest / CELL) * CELL + CELL - 1, F.col("at"))
    span = F.struct(
        (F.col("first") + F.col("at") - farthest).cast("long").alias("first"),
        (F.col("first") + F.col("at") - nearest).cast("long").alias("last"),
    )
    by_cell = whole_cells.select("doc_id", "tie", span.alias("span"))

    unclear = F.filter("cells", lambda c: c["open"] & ((c["n"] == 1) | (c["stands"] == F.col("id"))))
    to_sort = told.withColumn("cells", unclear).where(F.size("cells") > 0)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = repeated(to_sort, _cell_windows, sampled_boundaries(_sample(to_sort), partitions))
    by_window = places.select("doc_id", "tie", F.struct("start", F.col("start").alias("last")).alias("span"))
    spans = as_whole.unionAll(by_cell).unionAll(by_window)
    spans = stored(spans.groupBy("doc_id", "tie").agg(F.collect_set("span").alias("spans")), "spans")
    discard(met_, told)
    return spans


def _sample(contexts: DataFrame) -> list[bytes]:
    """Beginnings of windows, from about ``SAMPLE_ROWS`` stretches; they only balance the ranges."""
    every = max(1, contexts.count() // SAMPLE_ROWS)
    some = contexts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    rows = some.select(F.substring("body", 1, 24).alias("a"), F.expr("substring(body, more + 1, 24)").alias("b")).collect()
    return [bytes(x) for row in rows for x in row]


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint byte ranges, in order, covered by windows with starts in (first, last)."""
    out: list[list[int]] = []
    for first, last in sorted(map(tuple, spans.tolist())):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [(a, b) for a, b in out]


def _kept(body: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    if spans is None:
        return body, []
    gone = covered(np.column_stack([np.asarray(spans.field("first")), np.asarray(spans.field("last"))]))
    at, parts = 0, []
    for a, b in gone:
        parts.append(body[at:a])
        at = b
    return b"".join([*parts, body[at:]]), gone


def _each(texts: pa.Array, spans: pa.Array):
    for text, own in zip(texts, spans, strict=True):
        yield (text.as_py() or "").encode(), own.values if own.is_valid else None


def removal(text: Column, spans: Column) -> Column:
    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for body, own in _each(texts, spans):
            kept, gone = _kept(body, own)
            rows.append((len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return run.asNondeterministic()(text, spans)


def kept_text(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_kept(b, s)[0].decode("utf-8", errors="ignore") for b, s in _each(texts, spans)], pa.string())

    return run.asNondeterministic()(text, spans)


def _with_spans(documents: DataFrame) -> DataFrame:
    spans = repeated_spans(documents).select(
        F.col("doc_id").alias("_of_doc"), F.col("tie").alias("_of_tie"), F.col("spans").alias("_spans")
    )
    tie = F.xxhash64(F.coalesce(documents["text"], F.lit("")).cast("binary"))
    same = documents["doc_id"].cast("long").eqNullSafe(spans["_of_doc"]) & (tie == spans["_of_tie"])
    return documents.join(spans, same, "left")


def repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = _with_spans(documents.select("doc_id", "text"))
    return rows.select("doc_id", removal(F.col("text"), F.col("_spans")).alias("r")).select("doc_id", "r.*")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, with the repeated bytes taken out of ``text``; ``n_chars``,
    if there is one, is that of the new text."""
    names = documents.columns
    rows = _with_spans(documents)
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("_spans")))
    rows = rows.withColumn("text", text).select(*names)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return rows.select(*names)
