"""Lexical search, exact dedup and phrases against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import exact, lexical, phrases

from .conftest import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(documents, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, terms(t)) for i, t in documents]
    counted = [Counter(w) for _, w in docs]
    df = Counter(t for c in counted for t in c)
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, words), c in zip(docs, counted, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * len(words) * n_docs) // n_terms
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"broadcast_terms": 0, "block_docs": 3, "slice_items": 2}])
def test_search(spark, odd, odd_rows, none, limits):
    items = [(1, odd_rows[8][1]), (1, "one, ONE two!"), (None, "the lantern über 42 42"), (2, None), (3, "..."), (4, "nowhere"), (5, odd_rows[12][1][:9000])]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as score", "3 as item")
    for k in (1, 4, 10):
        assert rows_of(lexical.search(odd, table, k, **limits)) == plain_search(odd_rows, items, k)
    assert lexical.search(none, table, **limits).count() == 0
    assert lexical.search(odd, none.selectExpr("doc_id as item_id", "text"), **limits).count() == 0


def test_search_with_many_ties(spark, small_documents):
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5)))) for n in rng.sample(range(2000), 600)]
    items = [(n, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (7, 50, 4096):
        assert rows_of(lexical.search(docs, table, 10, block_docs=size, slice_items=16)) == plain_search(rows, items, 10)


def test_documents_out_of_reach_are_left_out():
    """A stage drops a document only if what is left can't lift it to the k-th score."""
    import pyarrow as pa

    add = lexical._stage(1000, 10_000, 2, False)
    bundles = pa.table({"item": [7], "at": [[0, 1, 2, 3]], "score": [[100, 90, 50, 39]]})
    asked = [[{"item": 7, "weight": 0, "rest": 50}]]
    owned = pa.table({"at": [[0]], "tf": [[1]], "n": [[10]], "asked": asked})
    key = (pa.scalar(1), pa.scalar(0))
    bundles = bundles.cast(pa.schema([("item", pa.int64()), ("at", pa.list_(pa.int32())), ("score", pa.list_(pa.int64()))]))
    assert add(key, bundles, owned)["at"].to_pylist() == [[0, 1, 2]]
    assert add(key, bundles, owned.slice(1))["at"].to_pylist() == [[0, 1, 2, 3]]
    last = lexical._stage(1000, 10_000, 2, True)
    assert last(key, bundles, owned)["score"].to_pylist() == [[100, 90]]


def test_parts_beyond_64_bits():
    import numpy as np

    tf, n, docs, terms = np.array([1, 7]), np.array([10**9, 3 * 10**9]), 10**11, 10**13
    want = [(10**9 * t) // (1000 * t + 8 * (25 + 75 * m * docs // terms)) for t, m in ((1, 10**9), (7, 3 * 10**9))]
    assert lexical.parts(tf, n, docs, terms).tolist() == want


def plain_duplicates(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for n, text in enumerate(norm):
        groups[text].append(n)
    out = []
    for text, members in groups.items():
        members.sort(key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
        sums = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[n][0], rows[members[0]][0], len(members), n == members[0], sums) for n in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "how", [{}, {"piece": 50, "broadcast_groups": 0}, {"piece": 64, "primes": (2,), "bases": (1,)}, {"primes": (1,), "bases": (1,), "broadcast_groups": 0}]
)
def test_duplicates(spark, odd, odd_rows, none, how):
    """Also with primes of 2 and 1, where nearly all texts of one length collide and only comparing tells them apart."""
    rng = random.Random(2)
    more = [(n, "".join(rng.choice("ab") for _ in range(7)) + rng.choice([" ", "\t \n"]) + "x" * rng.choice([3, 60, 130])) for n in range(100, 200)]
    extra = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in more], odd.schema)
    assert rows_of(exact.duplicates(odd.unionByName(extra), **how)) == plain_duplicates(odd_rows + more)
    assert exact.duplicates(none, **how).count() == 0


def test_large_group_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact, "PART_ROWS", 10)
    docs = spark.range(300).selectExpr("id as doc_id", "if(id % 3 = 0, 'same  text', concat('text ', id % 50)) as text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(exact.duplicates(docs)) == plain_duplicates(rows)


def test_fingerprints_compose(spark):
    text = "".join(random.Random(3).choice("abc é") for _ in range(5000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = [len(text.encode())] + [sum(c * pow(b, n, p) for n, c in enumerate(reversed(text.encode()))) % p for p, b in zip(exact.PRIMES, exact.BASES)]
    for piece in (100, 333, 10_000):
        hashed = exact.piece_hasher(exact.PRIMES, exact.BASES, piece)
        short, long_ = exact._short(docs, hashed, piece), exact._composed_long(exact._long(docs, hashed, piece), exact.PRIMES)
        assert [r.fp for r in short.select("fp").union(long_.select("fp")).collect()] == [":".join(map(str, want))]


def test_one_of_equal_texts_stays(odd, odd_rows):
    kept = exact.deduplicated(odd)
    assert kept.columns == odd.columns
    want = sorted(((i, s) for i, _, _, stays, s in plain_duplicates(odd_rows) if stays), key=repr)
    got = [(r.doc_id, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == want


def plain_collocations(rows, min_count=10, max_words=3, top=2000, percent=50):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            longer = [c for q, c in f.items() if len(q) > len(p) and c >= min_count and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= percent * a for c in longer):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=repr)


def planted_phrases(seed=4):
    rng = random.Random(seed)
    words = ["the", "old", "stone", "bridge", "Über", "señal", "x\x1cy", "\x00", "a", "b"]
    rows = [("en", None), (None, ""), ("en", " \t "), ("de", "Eins, zwei.")]
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(rng.randrange(25)))
        rows.append((rng.choice(["en", "en", "und", None]), text + " New York City " * rng.randrange(2)))
    return rows


@pytest.mark.parametrize("sample", [1, 3, 10**9])
def test_collocations(spark, sample):
    """The result is the same whether the sample proposes all or nothing."""
    rows = planted_phrases()
    docs = spark.createDataFrame([(n % 7 or None, t, lang, 1, 2) for n, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, words int, f int")
    got = phrases.collocations(docs.repartition(3), sample=sample)
    assert rows_of(got) == plain_collocations(rows)
    got = phrases.collocations(docs, min_count=5, max_words=4, top=9, cover_percent=70, sample=sample)
    assert rows_of(got) == plain_collocations(rows, 5, 4, 9, 70)


def test_collocations_of_odd_rows(odd, odd_rows, none, monkeypatch):
    rows = [(None, t) for _, t in odd_rows if not t or len(t) < 50_000]
    some = odd.where("text is null or length(text) < 50000")
    assert rows_of(phrases.collocations(some, sample=2)) == plain_collocations(rows)
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 20)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    assert rows_of(phrases.collocations(some, sample=2)) == plain_collocations(rows)
    assert phrases.collocations(odd, top=5).count() == 5
    assert phrases.collocations(none).count() == 0


def test_a_crowded_filter_loses_no_phrase(spark, monkeypatch):
    """Words that the sample missed come in with the second pass; that the filter of the first let their pairs
    pass in error doesn't mean that it counted what holds these."""
    given = phrases.bloom_filter
    lengths = []

    def crowded(some):
        lengths.append(1 + len(lengths) % 2)
        return np.full(1 << 17, 255, np.uint8) if lengths[-1] == 2 else given(some)

    monkeypatch.setattr(phrases, "bloom_filter", crowded)
    rows = [("en", "new york city and new york city")] * 6 + [(None, "so so so so")] * 5 + [("en", "york city hall")] * 9
    docs = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = rows_of(phrases.collocations(docs, sample=10**9))
    assert len(lengths) > 2 and got == plain_collocations(rows) and any(r[2] == "so so so" for r in got)


def test_filters_hold_what_they_were_given(spark):
    rows = [("en", f"w{n} w{n + 1}".encode()) for n in range(3000)]
    filter_ = phrases.bloom_filter(spark.createDataFrame(rows, "lang string, phrase binary"))
    import pyarrow as pa

    own = phrases._phrase_hashes(pa.array([p for _, p in rows]), ["en"] * 3000)
    other = phrases._phrase_hashes(pa.array([p for _, p in rows]), ["de"] * 3000)
    assert phrases._holds([filter_], own).all() and phrases._holds([filter_], other).mean() < 0.05
    words = phrases.word_hashes(pa.array([b"w1", b"w2"]), "en")
    assert phrases.extended(words[:1], words[1:])[0] == own[1]
