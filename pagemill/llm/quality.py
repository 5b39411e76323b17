"""Text quality by a sparse ensemble of rules over text statistics.

1. Every text gets the statistics of ``STATISTICS``; they see the text only.
2. Trees are grown on the statistics of labelled rows.  Every path from a root to a node is a rule,
   a conjunction of thresholds.
3. A logistic regression with an L1 penalty over the 0/1 values of the rules gives most of them
   weight zero.
4. The rules that are left are compiled into one column expression over the statistics, so scoring
   is a projection; the trees aren't needed any more.

Fitting reads at most about ``fit_rows`` labelled rows, chosen by a hash of doc_id; their ids are
broadcast to find the texts (16 bytes each).  Scoring reads every text whole.

Defined results: a null text counts as empty, and an empty text has a score like any other.  Without
labelled rows the score is 0.5; with labels of one kind only it is near that label.  A document that
is labelled more than once counts each time; labels without doc_id or without a value aren't used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

FIT_ROWS = 40_000
THRESHOLD = 0.7
TREES, DEPTH, BINS = 12, 4, 64
LASSO = 3e-4
LEAST_SUPPORT = 0.002

STATISTICS = [
    "log_chars",
    "words_per_char",
    "mean_word",
    "longest_word",
    "upper",
    "digits",
    "symbols",
    "exclaims",
    "stops_commas",
    "non_ascii",
    "distinct_words",
    "top_word",
    "repeated_next",
    "distinct_triples",
    "function_words",
    "marked_words",
    "short_words",
    "mean_line",
    "repeated_lines",
    "ended_lines",
]
#: Frequent function words of four languages.
FUNCTION_WORDS = """
the of and to in is that for it was on are as with by at from this be or an a
der die und das ist in von zu den mit auf für nicht ein eine sich des dem im er
de la le et les des en un une du que est pour pas dans par sur qui avec au
que el los del se las por un para con no una su al lo como más pero
""".split()
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@|<>{}[]\\/^~_=+`"
_STOPS = b".,;:"
_HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS``."""
    raw = text.encode("utf-8", errors="replace")
    size = len(raw) or 1
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    words = text.split()
    n = len(words) or 1
    counts = Counter(words)
    lengths = list(map(len, words))
    lines = [line for line in text.split("\n") if line.strip()]
    n_lines = len(lines) or 1
    triples = max(1, len(words) - 2)
    return [
        math.log1p(len(text)),
        len(words) / max(1, len(text)),
        sum(lengths) / n,
        float(max(lengths, default=0)),
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        share(b"!?"),
        share(_STOPS),
        share(_HIGH),
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n,
        sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / n,
        sum(1 for k in lengths if k < 3) / n,
        math.log1p(len(text) / n_lines),
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / n_lines,
    ]


def text_statistics(text: Column) -> Column:
    """A struct of ``STATISTICS``."""

    @F.arrow_udf(", ".join(f"{name} double" for name in STATISTICS))
    def run(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py() or "") for t in texts]
        columns = zip(*rows, strict=True) if rows else [[] for _ in STATISTICS]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=STATISTICS)

    return run.asNondeterministic()(text)


#: A rule is a conjunction of (statistic, "<=" or ">", threshold).
Rule = tuple[tuple[int, str, float], ...]


def tree_rules(debug: str) -> set[Rule]:
    """The path to every node but the root, from the printed form of a tree; of several bounds on one
    side of a statistic only the tightest stays."""
    rules: set[Rule] = set()
    path: list[tuple[int, str, float]] = []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1]) - _indent(debug)
            del path[depth:]
            path.append((int(found[2]), found[3], float(found[4])))
            bounds: dict[tuple[int, str], float] = {}
            for feature, side, at in path:
                tighter = min if side == "<=" else max
                bounds[feature, side] = tighter(at, bounds.get((feature, side), at))
            rules.add(tuple(sorted((f, s, at) for (f, s), at in bounds.items())))
    return rules


def _indent(debug: str) -> int:
    return min(len(m[1]) for m in re.finditer(r"^( *)If ", debug, re.M))


def rule_sql(rule: Rule, of: str) -> str:
    return " and ".join(f"{of}.{STATISTICS[f]} {side} {at!r}D" for f, side, at in rule)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; what is kept of a fit."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, of: str) -> Column:
        """The score as an expression over a struct column of statistics."""
        terms = [f"if({rule_sql(rule, of)}, {weight!r}D, 0D)" for rule, weight in self.weights]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'({self.intercept!r}D)', *terms])})))")


def fit(documents: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fit on ``labels`` (``doc_id`` and a 0/1 column) and the texts of ``documents``."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(
        "doc_id is not null and label is not null"
    )
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = stored(texts.select("label", text_statistics(F.col("text")).alias("s")), "statistics")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, all_ = counts.get(1.0, 0), sum(counts.values())
    prior = math.log((ones + 0.5) / (all_ - ones + 0.5))
    if not 0 < ones < all_:
        return RuleEnsemble(prior, ())
    inputs = array_to_vector(F.array(*(F.col("s")[name] for name in STATISTICS)))
    forest = RandomForestClassifier(
        featuresCol="inputs", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, subsamplingRate=0.7, seed=7
    ).fit(rows.select("label", inputs.alias("inputs")))
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees if t.depth)))
    met = rows.select("label", *(F.expr(rule_sql(r, "s")).cast("double").alias(f"r{n}") for n, r in enumerate(rules)))
    shares = met.agg(*(F.avg(f"r{n}").alias(f"r{n}") for n in range(len(rules)))).first()
    used = [n for n in range(len(rules)) if LEAST_SUPPORT <= shares[n] <= 1 - LEAST_SUPPORT]
    if not used:
        return RuleEnsemble(prior, ())
    values = array_to_vector(F.array(*(F.col(f"r{n}") for n in used)))
    lasso = LogisticRegression(
        featuresCol="values", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60
    ).fit(met.select("label", values.alias("values")))
    weights = [(rules[n], float(w)) for n, w in zip(used, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(float(lasso.intercept), tuple(weights))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def scored(documents: DataFrame, model: RuleEnsemble, name: str = "quality_score") -> DataFrame:
    """All columns of the documents, and the score."""
    within = f"{name}_statistics"
    whole = documents.withColumn(within, text_statistics(F.col("text")))
    return whole.withColumn(name, model.score(within)).drop(within)


def of_good_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, whose score reaches the threshold."""
    model = fit(documents, labels, "quality")
    name = "quality_score_of_text"
    return scored(documents, model, name).where(F.col(name) >= threshold).drop(name)
