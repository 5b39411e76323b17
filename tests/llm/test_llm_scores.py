"""Quality, toxicity, decontamination, archives, top-k and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyarrow import fs

import corpus_pipeline
from pagemill.llm import decontaminate, quality, queries, topk, toxicity, warc

from .conftest import rows_of
from .test_llm_copies import plain_near_copies, plain_repeats

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def accuracy(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50
    return sum(p == y for p, y in judged) / len(judged)


def test_quality_held_out(spark):
    rows = queries.QUERIES["op1_quality"](spark, MIDDLE).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(spark, rows, "quality") > 0.95


def test_toxicity_held_out(spark):
    rows = queries.QUERIES["op9_toxicity"](spark, MIDDLE).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(spark, rows, "toxic") > 0.93


def test_rules_of_a_tree():
    debug = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 3 <= 0.5)
   If (feature 3 <= 0.25)
    Predict: 0.0
   Else (feature 3 > 0.25)
    Predict: 1.0
  Else (feature 3 > 0.5)
   Predict: 1.0
"""
    le, gt = "<=", ">"
    assert quality.tree_rules(debug) == {
        ((3, le, 0.5),), ((3, le, 0.25),), ((3, le, 0.5), (3, gt, 0.25)), ((3, gt, 0.5),)
    }


def test_scores_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame(
        [(n, n % 2, n % 2) for n in range(15)] + [(None, 1, 1), (2, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int"
    )
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = quality.fit(odd, some, "quality")
        rows = quality.scored(odd, model, "s").collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.s <= 1 for r in rows)
        rows = toxicity.toxicity(odd, some).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality.of_good_quality(odd, labels).columns == odd.columns
    assert quality.scored(none, model).count() == 0 and toxicity.toxicity(none, labels).count() == 0


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(500):
        terms = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        rows.append((terms.astype(np.int64), rng.integers(1, 4, len(terms)).astype(float)))
    idf = rng.uniform(0.5, 3, 40)
    index = toxicity.Examples(list(range(500)), list(rng.integers(0, 2, 500)), rows, idf)
    dense = np.zeros((500, 40))
    for at, doc in enumerate(index.ids):
        terms, weights = index.vector(*rows[doc])
        dense[at, terms] = weights
    for n in range(200):
        terms, weights = index.vector(*rows[n])
        query = np.zeros(40)
        query[terms] = weights
        cosines = dense @ query
        best = np.sort(cosines[cosines > 0])[::-1][:15]
        found, near = index.nearest(terms, weights, 15)
        assert np.allclose(near, best) and np.allclose(cosines[found], near)


def plain_toxicity(documents, labels, vocabulary, k):
    """``doc_id -> (vote, nearest)`` by all cosines; ``nearest`` has doc_id, label and rounded cosine."""
    number = {t: n for n, t in enumerate(vocabulary)}
    counts = np.zeros((len(documents), len(vocabulary)))
    for row, (_, text) in enumerate(documents):
        for word in re.findall(r"\w+", (text or "").lower()):
            for term in [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]:
                if term in number:
                    counts[row, number[term]] += 1
    idf = np.log((len(documents) + 1) / ((counts > 0).sum(axis=0) + 1))
    vectors = np.log1p(counts) * idf
    sizes = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    vectors = np.divide(vectors, sizes, out=np.zeros_like(vectors), where=sizes > 0)
    known = [n for n, (i, _) in enumerate(documents) if i in labels]
    marks = np.array([labels[documents[n][0]] for n in known], dtype=float)
    bare = sizes[known, 0] == 0
    empty_vote, middle = (marks[bare].sum() + 0.5) / (bare.sum() + 1), (marks.sum() + 0.5) / (len(marks) + 1)

    def judged(row, skip=None):
        near = sorted((-round(float(vectors[row] @ vectors[n]), 10), documents[n][0], m) for n, m in zip(known, marks, strict=True))
        near = [x for x in near if x[0] < 0 and x[1] != skip][:k]
        if not near:
            return empty_vote, []
        pull = [1 / (0.05 + max(0, 2 + 2 * x[0]) ** 0.5) for x in near]
        weak = 1 / (0.05 + 2**0.5)
        vote = (sum(p * x[2] for p, x in zip(pull, near, strict=True)) + weak * middle) / (sum(pull) + weak)
        return vote, [(x[1], int(x[2]), -x[0]) for x in near]

    alone = [judged(n, documents[n][0])[0] for n in known]
    return {i: judged(n) for n, (i, _) in enumerate(documents)}, np.array(alone), marks


def test_toxicity_is_that_of_all_cosines(spark):
    documents = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").where("toxic in (0, 1)")
    vocabulary = toxicity.telling_terms(documents.join(labels, "doc_id").select("text", labels.toxic.alias("label")))
    want, alone, marks = plain_toxicity(
        [tuple(r) for r in documents.collect()], {r.doc_id: r.toxic for r in labels.collect()}, vocabulary, 5
    )
    curve = toxicity.Curve.fitted(alone, marks)
    rows = toxicity.toxicity(documents, labels, k=5).collect()
    assert len(vocabulary) > 5 and len(rows) == len(want)
    for r in rows:
        vote, near = want[r.doc_id]
        assert [(e.doc_id, e.label) for e in r.evidence] == [x[:2] for x in near]
        assert [e.cosine for e in r.evidence] == pytest.approx([x[2] for x in near], abs=1e-9)
        assert r.score == pytest.approx(float(curve(np.array([vote]))[0]), abs=1e-5)


def test_ties_of_examples_go_to_the_smaller_id():
    ids, one = [9, 4, 7, 1, 30, 2], np.zeros(1, np.int64)
    index = toxicity.Examples(ids * 40, [0] * 240, [(one, np.array([1.0 + n % 3])) for n in range(240)], np.array([1.7]))
    found, near = index.nearest(one, np.ones(1), 45, skip=1)
    assert index.ids[found].tolist() == [2] * 40 + [4] * 5 and set(near) == {1.0}


def plain_contamination(documents, benchmark, n=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for item, text in benchmark:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else []:
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in documents:
        w, hit, items = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    items |= found
        named = sorted({str(i) for i in items if i is not None})
        sums = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(named), sums, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_contamination(spark, odd, odd_rows, broadcast):
    passage = odd_rows[8][1]
    items = [
        (1, " ".join(passage.split()[3:20])), (2, "ONE, two!"), (3, "one"), (4, None), (5, "... !"), (None, "another text"),
        (6, " ".join(passage.split()[3:20])), (7, "minus"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as hash")
    got = decontaminate.contamination(odd, benchmark, broadcast_windows=broadcast).drop("hit_words")
    assert rows_of(got) == plain_contamination(odd_rows, items)
    kept = decontaminate.without_contaminated(odd, benchmark)
    clean = [row for row in odd_rows if not plain_contamination([row], items)[0][5]]
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    assert decontaminate.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), benchmark).count() == 0


def test_spans_of_hit_words(spark):
    """Spans that meet are one; the text is long, and both joins give the same."""
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    text = " ".join(f"w{rng.randrange(9)}" for _ in range(40_000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, t) for i, t in items if len(t.split()) > 3], "item_id long, text string")
    plain = plain_contamination([(1, text)], [tuple(r) for r in benchmark.collect()])[0]
    for broadcast in (decontaminate.BROADCAST_WINDOWS, 0):
        one, two, empty = decontaminate.contamination(docs, benchmark, broadcast_windows=broadcast).orderBy("doc_id").collect()
        assert one == two and tuple(one)[:6] == plain and empty.hit_words == []
        spans = [(s.start, s.end) for s in one.hit_words]
        assert sum(e - s for s, e in spans) == one.n_hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_clean_texts_stay_beside_contaminated_ones(spark):
    """Without an id or under one that repeats, each text is judged on its own."""
    item = "seven quiet lanterns by the river stone of the old harbour"
    rows = [(None, f"so {item} it goes"), (None, "clean, without id"), (7, item), (7, "clean, of document seven"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows_of(decontaminate.without_contaminated(docs, benchmark)) == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_archive(spark, tmp_path):
    pages = [
        (3, "u3", "<p>same</p>"), (1, "u1\r\nx", "<p>same</p>"), (2, None, "<p>é</p>"), (4, "u4", None), (5, "u5", ""),
        (None, "u", "<p>same</p>"), (None, "u", "only"), (1, "u1", "<p>same</p>"), (9, "big", "x" * 3_000_000),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as size", "'d' as digest")
    folder = warc.write_archive(table.repartition(2), f"file://{tmp_path}/archive")
    got = warc.read_archive(spark, folder)
    want = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        firsts = [p for p, _, h in pages if (h or "").encode() == body and p is not None]
        first = min(firsts, default=None)
        refers = first if page_id != first else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, len(body), digest, "response" if refers is None else "revisit", refers))
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=repr)
    for row in got.where("record_type = 'response'").collect():
        assert warc.base32_sha1(bytes(row.payload)) == row.payload_digest
    one = got.where("page_id = 9").select("record_id")
    assert warc.lookup(spark, folder, one).first().payload_bytes == 3_000_000
    index = spark.read.parquet(f"{folder}/index").toPandas()
    for bundle, rows in index.groupby("bundle"):
        system, path = fs.FileSystem.from_uri(bundle)
        raw = system.open_input_file(path).readall()
        sizes = warc.seek_table(raw)
        assert len(sizes) == rows.frame.nunique()
        plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)
        assert plain.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.read_archive(spark, warc.write_archive(table.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for n in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [1.0])]
    rows += [(None, [9.0] * 6), (50, [0.5] * 6), (406, [3e30] * 6), (450, [-3e30] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    ok = [
        (i, [min(max(int(np.floor(256 * x)), -(2**63)), 2**63 - 1) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for q, a in (r for r in ok if r[0] % 50 == 0):
        scores = [(min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1), i) for i, b in ok if i != q]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:5]
        want += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    asked = table.where("vec_id % 50 = 0")
    for slice_rows in (topk.SLICE_ROWS, 3):
        assert rows_of(topk.top_k(table.repartition(3), asked, slice_rows=slice_rows)) == sorted(want, key=repr)
    assert topk.top_k(table.limit(0), asked.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents").selectExpr("*", "'x' as score", "1 as spans")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SMALL)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/{n}")
        after = {r.doc_id: r for r in docs.collect()}
        if n == 0:
            bad = {r.doc_id for r in queries.table(spark, SMALL, "labels").where("quality = 0").collect()}
            assert len(after) > 100 and len(bad & set(after)) <= 0.1 * len(bad)
        elif n == 1:
            assert set(after) == {i for i, _, c in plain_near_copies(before) if i == c}
        elif n == 2:
            removed = {r[0]: r for r in plain_repeats(before)}
            texts = dict(before)
            for i, row in after.items():
                kept = row.text.encode()
                assert hashlib.sha256(kept).hexdigest() == removed[i][4] or not texts[i].isascii()
        elif n == 3:
            items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
            assert set(after) == {r[0] for r in plain_contamination(before, items) if not r[5]}
        else:
            assert sorted(after) == sorted(i for i, _ in before)
            assert all(r.n_tokens == len(r.ids) for r in after.values())


def test_pipeline_runs_as_its_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
