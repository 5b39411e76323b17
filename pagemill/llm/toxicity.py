"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with block-max indexes.

Terms are lower-case words and the first four, five and six letters of longer ones.  The vocabulary is
what labels tell apart: terms whose log odds between the two labels are at least ``LEAST_ODDS`` and
``LEAST_Z`` standard errors from zero, at most ``VOCABULARY`` of them.  A text's vector has
``log(1 + count) * idf`` for each; document frequencies are counted over all documents.

The examples, at most about ``fit_rows`` labelled rows chosen by hashes of doc_id and, where a doc_id
has many rows, of the row, are held in an inverted index: postings of a term, in blocks of ``BLOCK`` examples with the largest weight of each.
A query sums the block maxima of its terms, visits blocks from the highest bound down, and stops when
the next bound is below its k-th cosine, so the k nearest are exact.  Each votes with the inverse of
its distance; a logistic curve, fitted to the votes of the examples without themselves, makes scores
of votes.  Examples, index and vocabulary are bounded by ``fit_rows`` and ``VOCABULARY``, and are all
that is broadcast.

Defined results: a null text counts as empty.  A text that shares no term with an example gets the
share of label 1 among the examples without terms, made smooth, as its vote, and no evidence.  Of
cosines that are equal to 12 decimals the smaller doc_ids are taken.  Without labelled rows scores are 0.5.  Repeated rows are
scored each, and are one example; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .vocabulary import Kept

FIT_ROWS = 16_000
VOCABULARY = 8_192
LEAST_Z, LEAST_ODDS = 3.5, 1.0
NEAREST = 15
BLOCK = 64
THRESHOLD = 0.7
KEPT_WORDS = 200_000
KEPT_VOTES = 4_096
WORD = re.compile(r"\w+")


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


def distinct_terms(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            words = set(WORD.findall((text.as_py() or "").lower()))
            rows.append(list({t for w in words for t in word_terms(w)}))
        return pa.array(rows, pa.list_(pa.string()))

    return run.asNondeterministic()(text)


def telling_terms(texts: DataFrame) -> list[str]:
    """The vocabulary, from ``text, label`` of the examples."""
    totals = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return []
    counted = texts.select("label", F.explode(distinct_terms(F.col("text"))).alias("term")).groupBy("term")
    counted = counted.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).where("a + b >= 4")
    odds = f"ln((a + 0.5D) / ({ones} - a + 0.5D)) - ln((b + 0.5D) / ({zeros} - b + 0.5D))"
    error = f"sqrt(1 / (a + 0.5D) + 1 / (b + 0.5D) + 1 / ({ones} - a + 0.5D) + 1 / ({zeros} - b + 0.5D))"
    told = counted.select("term", F.expr(odds).alias("odds"), F.expr(f"abs({odds}) / {error}").alias("z"))
    told = told.where((F.col("z") >= LEAST_Z) & (F.abs("odds") >= LEAST_ODDS))
    return sorted(r.term for r in told.orderBy(F.desc("z"), "term").limit(VOCABULARY).collect())


def term_counts(text: Column, sent) -> Column:
    """``terms`` and ``counts`` of a text within the vocabulary, as numbers."""

    @F.arrow_udf("terms array<int>, counts array<int>")
    def run(texts: pa.Array) -> pa.Array:
        numbers = {t: n for n, t in enumerate(sent.value)}
        kept = Kept(lambda w: tuple(numbers[t] for t in word_terms(w) if t in numbers), KEPT_WORDS)
        terms, counts = [], []
        for text in texts:
            known, find, found = kept.young, kept.find, []
            for word in WORD.findall((text.as_py() or "").lower()):
                ids = known.get(word)
                found.extend(find(word) if ids is None else ids)
            tally = Counter(found)
            terms.append(list(tally))
            counts.append(list(tally.values()))
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(terms, kind), pa.array(counts, kind)], names=["terms", "counts"])

    return run.asNondeterministic()(text)


class Examples:
    """Block-max inverted index of the labelled examples."""

    def __init__(self, ids: list[int], labels: list[int], rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.idf = idf
        vectors = [self.vector(*row) for row in rows]
        # Examples with the same heaviest term stand together, so that block maxima are tight.
        lead = [int(t[np.argmax(w)]) if len(t) else len(idf) for t, w in vectors]
        # Examples with equal vectors are one entry of the index.
        alike: dict[tuple[bytes, bytes], int] = {}
        group = [alike.setdefault((t.tobytes(), w.round(12).tobytes()), len(alike)) for t, w in vectors]
        ids, group = np.array(ids, dtype=np.int64), np.array(group, dtype=np.int64)
        order = np.lexsort((ids, group, np.array(lead, dtype=np.int64)))
        self.ids = ids[order]
        self.labels = np.array(labels, dtype=np.float64)[order]
        none = np.array([not len(vectors[n][0]) for n in order], dtype=bool)
        firsts = np.flatnonzero(np.diff(group[order], prepend=-1))
        self.firsts = np.append(firsts, len(order))
        vectors = [vectors[n] for n in order[firsts]]
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        owner = np.repeat(np.arange(len(vectors)), sizes)
        by_term = np.lexsort((owner, terms))
        self.owner, self.weights = owner[by_term], weights[by_term]
        self.blocks = -(-len(vectors) // BLOCK)
        self.most = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.most, (terms, owner // BLOCK), weights)
        # Where the postings of a term in a block begin; they end where the next begin.
        keys = terms[by_term] * self.blocks + self.owner // BLOCK
        self.starts = np.searchsorted(keys, np.arange(len(idf) * self.blocks + 1))
        self.empty_vote = (self.labels[none].sum() + 0.5) / (none.sum() + 1.0)
        self.middle = (self.labels.sum() + 0.5) / (len(self.labels) + 1.0)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms in ascending order and weights, of length one."""
        order = np.argsort(terms)
        terms, counts = terms[order], counts[order]
        weights = np.log1p(counts) * self.idf[terms]
        size = np.sqrt((weights**2).sum())
        return (terms, weights / size) if size else (terms[:0], weights[:0])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, exact; those with the doc_id ``skip`` are left out."""
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.blocks:
            return found, cosines
        bounds = weights @ self.most[terms]
        for block in np.argsort(-bounds, kind="stable"):
            # Bounds and cosines are sums in another order, so a bound is taken as a little higher.
            if bounds[block] <= 0 or (len(found) == k and bounds[block] + 1e-9 < cosines[-1]):
                break
            low, scores = block * BLOCK, np.zeros(BLOCK)
            firsts = terms * self.blocks + block
            for weight, a, b in zip(weights, self.starts[firsts], self.starts[firsts + 1], strict=True):
                if b > a:
                    scores[self.owner[a:b] - low] += weight * self.weights[a:b]
            scores = scores.round(12)  # equal vectors may differ in the last bit
            if skip is not None:
                firsts = self.firsts[low : low + BLOCK + 1]
                others = self.ids[firsts[0] : firsts[-1]] != skip
                scores[: len(firsts) - 1] *= np.logical_or.reduceat(others, firsts[:-1] - firsts[0])
            hit = np.flatnonzero((scores > 0) & (scores >= (cosines[-1] if len(found) == k else 0)))
            if not len(hit):
                continue
            found, cosines = np.concatenate([found, hit + low]), np.concatenate([cosines, scores[hit]])
            best = np.lexsort((self.ids[self.firsts[found]], -cosines))[:k]
            found, cosines = found[best], cosines[best]
        members = [np.arange(self.firsts[v], self.firsts[v + 1]) for v in found]
        members = [(m if skip is None else m[self.ids[m] != skip])[:k] for m in members]
        cosines = np.repeat(cosines, [len(m) for m in members])
        found = np.concatenate([found[:0], *members])
        best = np.lexsort((self.ids[found], -cosines))[:k]
        return found[best], cosines[best]

    def vote(
        self, terms: np.ndarray, counts: np.ndarray, k: int, own_id: int | None = None
    ) -> tuple[float, np.ndarray, np.ndarray]:
        """Distance-weighted share of label 1 among the nearest, their numbers and cosines."""
        terms, weights = self.vector(terms, counts)
        found, cosines = self.nearest(terms, weights, k, own_id)
        if not len(found):
            return float(self.empty_vote), found, cosines
        votes = 1 / (0.05 + np.sqrt(np.maximum(0, 2 - 2 * cosines)))
        # One weak vote for the share of label 1 among all examples.
        weak = 1 / (0.05 + np.sqrt(2))
        share = (votes @ self.labels[found] + weak * self.middle) / (votes.sum() + weak)
        return float(share), found, cosines


@dataclass
class Curve:
    """Score as a logistic function of the vote's log odds."""

    slope: float = 1.0
    shift: float = 0.0

    def __call__(self, vote: np.ndarray) -> np.ndarray:
        vote = np.clip(vote, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(vote / (1 - vote)) + self.shift, -35, 35)))

    @classmethod
    def fitted(cls, votes: np.ndarray, labels: np.ndarray) -> Curve:
        votes = np.clip(votes, 1e-6, 1 - 1e-6)
        x = np.column_stack([np.log(votes / (1 - votes)), np.ones(len(votes))])
        at, pull = np.array([1.0, 0.0]), 1e-2  # a weak pull towards the vote itself
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
            slope = x.T @ (labels - p) - pull * (at - (1, 0))
            bend = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
            step = np.linalg.solve(bend, slope)
            at = at + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return cls(max(float(at[0]), 1e-3), float(at[1]))


def toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, k: int = NEAREST) -> DataFrame:
    """``doc_id, score, evidence``: the score, and doc_id, label and cosine of the nearest examples.

    ``labels`` has ``doc_id`` and a 0/1 column; labels without either are not used.
    """
    spark = documents.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    known = F.broadcast(known)
    vocabulary = telling_terms(documents.select("doc_id", "text").join(known, "doc_id").select("text", "label"))
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = stored(documents.select("doc_id", term_counts(F.col("text"), sent).alias("t")).select("doc_id", "t.*"), "terms")
    found = rows.select("terms").mapInArrow(_term_texts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequencies = {r.term: r.n for r in found.collect()}  # one row for each term of the vocabulary
    all_ = rows.count()
    idf = np.array([np.log((all_ + 1) / (frequencies.get(n, 0) + 1)) for n in range(len(vocabulary))])
    examples = _bounded(rows.join(known, "doc_id").dropDuplicates(), fit_rows)
    held = examples.collect()
    index = Examples([r.doc_id for r in held], [r.label for r in held], [_arrays(r.terms, r.counts) for r in held], idf)
    shared, curve = spark.sparkContext.broadcast(index), Curve()
    if held:
        dealt = examples.repartition(spark.sparkContext.defaultParallelism)  # few bytes, much work
        alone = dealt.mapInArrow(_left_out(shared, k), "vote double, label int").toArrow()
        curve = Curve.fitted(np.asarray(alone["vote"]), np.asarray(alone["label"], dtype=float))
    return rows.mapInArrow(
        _scored(shared, curve, k), "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>"
    )


def _bounded(examples: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` of the examples, by a hash of the row, if a repeated doc_id makes them over twice that."""
    total = examples.count()
    if total <= 2 * fit_rows:
        return examples
    return examples.where(F.pmod(F.xxhash64(*examples.columns), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))


def _arrays(terms, counts) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(terms, dtype=np.int64), np.asarray(counts, dtype=np.float64)


def _term_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each term, one row for a task and term; a text has each of its terms once."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        seen = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(total))
        seen[: len(total)] += total
        total = seen
    used = np.flatnonzero(total)
    yield pa.record_batch({"term": pa.array(used.astype(np.int32)), "n": pa.array(total[used].astype(np.int64))})


def _left_out(shared, k: int):
    """Votes of examples among all others, and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("terms"), batch.column("counts"), strict=True)
            votes = [index.vote(*_arrays(terms.as_py(), counts.as_py()), k, doc_id)[0] for doc_id, terms, counts in rows]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("label")], names=["vote", "label"])

    return run


def _scored(shared, curve: Curve, k: int):
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value

        @lru_cache(maxsize=KEPT_VOTES)  # copies have the same terms in the same order
        def judged(terms: bytes, counts: bytes) -> tuple[float, list[dict]]:
            vote, found, cosines = index.vote(np.frombuffer(terms, np.int64), np.frombuffer(counts, np.float64), k)
            near = zip(index.ids[found].tolist(), index.labels[found].astype(int).tolist(), cosines.tolist(), strict=True)
            return vote, [{"doc_id": i, "label": y, "cosine": c} for i, y, c in near]

        for batch in batches:
            votes, shown = [], []
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                vote, near = judged(*(x.tobytes() for x in _arrays(terms.as_py(), counts.as_py())))
                votes.append(vote)
                shown.append(near)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(curve(np.array(votes))), pa.array(shown, evidence)],
                names=["doc_id", "score", "evidence"],
            )

    return run
