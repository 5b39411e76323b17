"""SimHash components, suffix sorting and repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import components, repeats, simhash, suffix_sort

from .conftest import rows_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[top(a)] = top(b)
    return [top(n) for n in range(len(prints))]


def plain_near_copies(rows):
    prints = [plain_simhash(t) for _, t in rows]
    group = plain_components(prints)
    first = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            first[g] = min(doc_id, first.get(g, doc_id))
    return sorted(((i, f"{p:016x}", first.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=repr)


def test_near_copies(odd, odd_rows):
    assert rows_of(simhash.near_copies(odd)) == plain_near_copies(odd_rows)


def test_near_copies_of_a_real_table(small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    assert rows_of(simhash.near_copies(small_documents)) == plain_near_copies(rows)


def test_large_group_in_chunks(spark):
    """More fingerprints around one centre than a unit takes: same components as all pairs."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 600:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    ordered = sorted(prints)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in ordered]
    table = spark.createDataFrame(signed, "bits long")
    links = simhash.close_pairs(table, group_rows=16)
    roots = {r.node: r.root for r in components.connected_components(links.toDF("a", "b")).collect()}
    group = plain_components(ordered)
    by_group, by_root = {}, {}
    for (bits,), g in zip(signed, group, strict=True):
        by_group.setdefault(g, set()).add(bits)
        by_root.setdefault(roots.get(bits, bits), set()).add(bits)
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_root.values()))


def test_one_crowd_is_split_without_losing_links(spark):
    """Fingerprints that agree on three blocks of five and fill the rest: same links as all pairs, and no
    group of two blocks is compared whole."""
    rng = random.Random(16)
    base = rng.getrandbits(64)
    ordered = sorted({base ^ rng.getrandbits(25) for _ in range(1_500)} | {base ^ (1 << b) for b in range(25)} | {base})
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in ordered], "bits long")
    links = simhash.close_pairs(table, group_rows=32)
    roots = {r.node: r.root for r in components.connected_components(links.toDF("a", "b")).collect()}
    prints = np.array(ordered, dtype=np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    own = np.arange(len(prints))
    while not np.array_equal(own, lower := np.where(close, own[None, :], len(own)).min(axis=1)):
        own = lower
    want, got = {}, {}
    for p, g in zip(prints.view(np.int64).tolist(), own.tolist(), strict=True):
        want.setdefault(g, set()).add(p)
        got.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 1 < len(want) < len(prints)


def test_parts_of_a_mask(spark):
    masks = [0, 1, -1, -(1 << 63), 0b1011, (1 << 40) - 1]
    found = spark.createDataFrame([(m,) for m in masks], "mask long").select("mask", simhash._parts(F.col("mask")).alias("parts")).collect()
    for r in found:
        seen = 0
        for part in r.parts:
            assert not seen & part
            seen |= part
        assert seen == r.mask and len(r.parts) == 4
        assert max(p.bit_count() for p in (x % (1 << 64) for x in r.parts)) == -(-(r.mask % (1 << 64)).bit_count() // 4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (7, 3), (3, 7)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    want = [(i, 100) for i in range(101, 161)] + [(i, 3) for i in [7, *range(200, 260)]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_of_each_group_stays(odd, odd_rows):
    """One row of each component, under its smallest id, none last."""
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    group = plain_components([plain_simhash(t) for _, t in odd_rows])
    first = {}
    for (doc_id, _), g in zip(odd_rows, group, strict=True):
        first[g] = min(first.get(g, (True, 0)), (doc_id is None, doc_id or 0))
    of_text = {text: g for (_, text), g in zip(odd_rows, group, strict=True)}
    got = {of_text[r.text]: (r.doc_id is None, r.doc_id or 0) for r in kept.collect()}
    assert got == first and kept.count() == len(first)


def test_one_text_of_each_group_stays_without_ids(spark):
    """Groups whose rows have no id or one that repeats: judged by texts, not by ids."""
    rows = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "delta epsilon zeta eta"), (None, None), (5, "theta iota"), (5, "kappa"), (5, "kappa"), (6, "ALPHA beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, "delta epsilon zeta eta"), (None, None), (5, "theta iota"), (5, "kappa"), (6, "ALPHA beta gamma")]
    assert rows_of(simhash.deduplicated(docs)) == sorted(want, key=repr)


def plain_repeats(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(odd, odd_rows):
    rows = [(i, t) for i, t in odd_rows if not t or len(t) < 100_000]
    some = odd.where("text is null or length(text) < 100000")
    assert rows_of(repeats.repeats(some)) == plain_repeats(rows)


def test_repeats_of_all_lengths(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(700))
    rows = []
    for i in range(60):
        at, size = rng.randrange(400), rng.choice([150, 198, 199, 200, 201, 205, 208, 230, 300])
        noise = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        rows.append((i, noise("xyzwé ") + passage[at : at + size] + noise("uvst")))
    rows += [(100, "a" * 900), (101, "b" * 200), (102, "b" * 199), (103, "Cimex " * 90), (104, "xCimex " * 70)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(repeats.repeats(table)) == plain_repeats(rows)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijkl") for _ in range(9_000))
    pieces = list(repeats.text_pieces([text.encode()]))
    assert pieces == [[(0, 0, text.encode())]]
    monkeypatch.setattr(repeats, "PIECE_BYTES", 1_000)
    cut = [p for group in repeats.text_pieces([text.encode(), b"x" * 199, text[:300].encode()]) for p in group]
    starts = [(row, at + n) for row, at, raw in cut for n in range(len(raw) - 199)]
    assert starts == [(0, n) for n in range(8_801)] + [(2, n) for n in range(101)]


def test_text_without_repeats(odd, odd_rows):
    kept = repeats.without_repeats(odd.where("text is null or length(text) < 100000"))
    assert kept.columns == odd.columns
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[0] is None and by_id[1] == "" and by_id[4] == "one two" and by_id[8] == ""
    assert by_id[10] == "before  after" or by_id[10].startswith("before")


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(9)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    for k in (1, 2, 3, 7):
        runs = []
        for n in range(k):
            run = sorted(words[n::k])
            shared = suffix_sort.shared_prefixes(run)
            body = b"".join(s[h:] for s, h in zip(run, shared, strict=True))
            assert [s for s, _ in suffix_sort.decoded(body, shared, list(map(len, run)))] == run
            runs.append(iter(list(zip(run, shared, strict=True))))
        merged = list(suffix_sort.merged_runs(runs))
        assert [s for _, s, _ in merged] == sorted(words)
        for (_, a, _), (_, b, h) in zip(merged, merged[1:], strict=False):
            assert h == suffix_sort.common_prefix(a, b, 0)


def test_empty_tables(none):
    assert simhash.near_copies(none).count() == 0
    assert simhash.deduplicated(none).count() == 0
    assert repeats.repeats(none).count() == 0
    assert repeats.without_repeats(none).columns == none.columns
