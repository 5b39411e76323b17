"""A distributed merge sort of suffixes that never compares a known prefix twice.

A task sorts what it has into runs, collapses equal suffixes, cuts each run at the range boundaries
and front-codes every piece: for a suffix the number of bytes it shares with the one before, and the
bytes that follow.  Pieces are exchanged by range.  A range is combined by a loser tree over its
pieces in which every contender carries the length of its common prefix with the last suffix that
left the tree: the longer prefix wins unseen, and only on a tie are bytes compared, from there on.
What leaves the tree comes with its common prefix with the one before, so equal neighbours are seen
without a further comparison.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RUN_BYTES = 12 << 20
RANGES_PER_PARTITION = 4
PIECE = (
    "part int, body binary, shared binary, sizes binary,"
    " doc_id array<long>, tie array<long>, start array<long>, known array<boolean>"
)
PLACE = "doc_id long, tie long, start long"
Suffix = tuple[bytes, int | None, int, int]


def repeated(
    rows: DataFrame, suffixes: Callable[[pa.RecordBatch], Iterator[Suffix]], boundaries: list[bytes]
) -> DataFrame:
    """``doc_id, tie, start`` of the suffixes that are equal to another.

    ``suffixes`` makes (bytes, doc_id, tie, start) of a batch; those with ``start`` below zero are
    compared, but not reported.  ``boundaries`` are sorted and cut the order into ranges.
    """
    sent = rows.sparkSession.sparkContext.broadcast(boundaries)
    pieces = rows.mapInArrow(_front_coded(suffixes, sent), PIECE)
    return pieces.repartition("part").mapInArrow(_merged, PLACE)


def _front_coded(suffixes, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Suffix] = []
        size = turn = 0
        for batch in batches:
            for one in suffixes(batch):
                waiting.append(one)
                size += len(one[0])
                if size >= RUN_BYTES:
                    yield from run_pieces(waiting, sent.value, turn)
                    waiting, size, turn = [], 0, turn + 1
        if waiting:
            yield from run_pieces(waiting, sent.value, turn)

    return run


def run_pieces(waiting: list[Suffix], boundaries: list[bytes], turn: int = 0) -> Iterator[pa.RecordBatch]:
    """One sorted run: places known to repeat, and the different suffixes in pieces by range."""
    waiting.sort(key=lambda s: s[0])
    entries: list[tuple[bytes, int | None, int, int, bool]] = []
    again: list[Suffix] = []
    n = 0
    while n < len(waiting):
        end = n + 1
        while end < len(waiting) and waiting[end][0] == waiting[n][0]:
            end += 1
        if end - n > 1:
            again += [s for s in waiting[n:end] if s[3] >= 0]
        entries.append((*waiting[n], end - n > 1 or waiting[n][3] < 0))
        n = end
    if again:
        yield _row(-1 - turn, b"", [], [], again, [True] * len(again))
    strings = [e[0] for e in entries]
    shared = shared_prefixes(strings)
    n = 0
    while n < len(entries):
        part = bisect_right(boundaries, strings[n])
        end = n + 1
        while end < len(entries) and (part == len(boundaries) or strings[end] < boundaries[part]):
            end += 1
        shared[n] = 0
        piece = range(n, end)
        body = b"".join([strings[i][shared[i] :] for i in piece])
        sizes = [len(strings[i]) for i in piece]
        yield _row(part, body, shared[n:end], sizes, [e[:4] for e in entries[n:end]], [e[4] for e in entries[n:end]])
        n = end


def shared_prefixes(strings: list[bytes]) -> list[int]:
    """Length of the common prefix of each string with the one before, 0 for the first."""
    out = [0]
    for start in range(0, len(strings) - 1, 4096):
        some = strings[start : start + 4097]
        sizes = np.array(list(map(len, some)))
        width = int(sizes.max(initial=0))
        grid = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in some]), np.uint8).reshape(len(some), width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(some) - 1, int)
        out += np.minimum(first, np.minimum(sizes[1:], sizes[:-1])).tolist()
    return out


def _row(part: int, body: bytes, shared, sizes, places, known) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    columns = list(zip(*places, strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([body], pa.binary()),
            pa.array([np.array(shared, np.int32).tobytes()], pa.binary()),
            pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()),
            *(pa.array([list(columns[n])], longs) for n in (1, 2, 3)),
            pa.array([known], pa.list_(pa.bool_())),
        ],
        names=["part", "body", "shared", "sizes", "doc_id", "tie", "start", "known"],
    )


def decoded(body: bytes, shared: list[int], sizes: list[int]) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded piece, each with its common prefix with the one before."""
    last, at = b"", 0
    for same, size in zip(shared, sizes, strict=True):
        rest = size - same
        last = last[:same] + body[at : at + rest]
        at += rest
        yield last, same


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    end = min(len(a), len(b))
    while at < end:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            n = min(len(x), len(y))
            odd = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + (n - (odd.bit_length() + 7) // 8 if odd else n)
        at += 32
    return end


def merged_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Run, suffix and its common prefix with the suffix before, in sorted order."""
    k = len(runs)
    heads: list[bytes] = [b""] * k
    same = [0] * k  # common prefix with the last winner; -1: the run has ended
    for r in range(k):
        heads[r], same[r] = next(runs[r], (b"", -1))
    losers = [-1] * k

    def climb(run: int, node: int) -> int:
        """Play from a node up; an empty place keeps the contender (only while the tree is built)."""
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = run
                return -1
            if same[run] == same[other] and same[run] >= 0:
                a, b = heads[run], heads[other]
                known = same[run]
                upto = common_prefix(a, b, known)
                # The loser's prefix is now that with the winner.
                if upto == len(a) or (upto < len(b) and a[upto] < b[upto]):
                    same[other] = upto
                else:
                    same[run] = upto
                    losers[node], run = run, other
            elif same[run] < same[other]:
                losers[node], run = run, other
            node //= 2
        return run

    champion = 0
    for r in range(k):
        champion = climb(r, (r + k) // 2)
    while same[champion] >= 0:
        yield champion, heads[champion], same[champion]
        heads[champion], same[champion] = next(runs[champion], (b"", -1))
        champion = climb(champion, (champion + k) // 2)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                yield _places(zip(row["doc_id"], row["tie"], row["start"], strict=True))
            else:
                ranges.setdefault(row["part"], []).append(row)
    for part in sorted(ranges):
        yield _places(equal_places(ranges.pop(part)))


def equal_places(pieces: list[dict]) -> Iterator[tuple[int | None, int, int]]:
    """Places in the pieces of one range whose suffix is also in another piece."""
    ints = lambda raw: np.frombuffer(raw, np.int32).tolist()
    runs = [decoded(p["body"], ints(p["shared"]), ints(p["sizes"])) for p in pieces]
    taken = [0] * len(pieces)
    before, size, told = None, -1, True
    for run, suffix, same in merged_runs(runs):
        here = run, taken[run]
        taken[run] += 1
        equal = before is not None and same == len(suffix) == size
        if equal:
            for r, n in ([here] if told else [before, here]):
                if not pieces[r]["known"][n]:
                    yield pieces[r]["doc_id"][n], pieces[r]["tie"][n], pieces[r]["start"][n]
        before, size, told = here, len(suffix), equal


def _places(places) -> pa.RecordBatch:
    columns = list(zip(*places, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "tie", "start"])


def sampled_boundaries(samples: list[bytes], partitions: int) -> list[bytes]:
    """Up to ``RANGES_PER_PARTITION`` ranges for each partition, from a sample of suffixes."""
    ordered = sorted(samples)
    ranges = max(1, partitions * RANGES_PER_PARTITION)
    cuts = {ordered[len(ordered) * n // ranges] for n in range(1, ranges)} if ordered else set()
    return sorted(cuts)
