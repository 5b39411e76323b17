"""Encoding, counting and token files against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagemill.llm import bpe, token_counts, token_files
from pagemill.llm.vocabulary import Vocabulary

from .conftest import rows_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_encode_as_library(spark, odd, odd_rows, library):
    want = []
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        want.append((doc_id, len(ids), *sums, ids))
    got = bpe.encode_documents(odd, BYTE_BPE, with_ids=True)
    assert rows_of(got) == sorted(((*w,) for w in want), key=repr)


def test_round_trip(odd_rows):
    codec = bpe.codec(BYTE_BPE)
    for _, text in odd_rows:
        assert codec.decode(codec.encode(text or "")) == (text or "")


def test_spaces_as_library(library):
    codec, rng = bpe.codec(BYTE_BPE), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\ta'sx1, ") for _ in range(rng.randrange(12)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_array_and_heap_agree():
    v, rng = Vocabulary(BYTE_BPE), random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("theinoaxé ") for _ in range(rng.randrange(1, 80)))
        symbols = v.word_symbols(word)
        merged = bpe.contiguous_merge(symbols, v.merges)
        assert merged == token_counts.chained_merge(symbols, v.merges)
        assert token_counts.count_merged(symbols, v.merges) == len(merged)


def test_counts_as_library(spark, odd, odd_rows, library):
    want = []
    for doc_id, text in odd_rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert rows_of(token_counts.count_tokens(odd, BYTE_BPE)) == sorted(want, key=repr)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, odd_rows, tmp_path, encoding):
    library, folder = Tokenizer.from_file(WORD_BPE), f"file://{tmp_path}/ids"
    token_files.write_token_ids(odd, WORD_BPE, folder, encoding=encoding)
    got = rows_of(token_files.token_digest(spark, folder))
    want, unique = {}, [i for i, _ in odd_rows if [j for j, _ in odd_rows].count(i) == 1]
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert len(got) == len(odd_rows)
    start = 0
    for doc_id in sorted(want, key=lambda i: (i is not None, i or 0)):
        own = sorted((r for r in got if r[0] == doc_id), key=lambda r: r[1])
        assert sorted(r[2:] for r in own) == sorted(want[doc_id])
        for row in own:
            assert row[1] == start
            start += row[2]
    assert unique


def test_word_ids_as_library():
    library, encoder = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(" \n\tAa'sxÉéς1, \x1c<|endoftext|>") for _ in range(rng.randrange(14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_letters_go_to_the_model_alone(monkeypatch):
    """The library encodes plain words as one text, not each by itself; what they are put together to is the same."""
    library, encoder = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    monkeypatch.setattr(token_files, "TEXT_BYTES", 2_000)
    rng, asked = random.Random(7), []
    encoded = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda texts: asked.extend(texts) or encoded(texts))
    letters = [chr(n) for n in range(0x250) if chr(n).isalpha()]
    words = ["".join(rng.choices(letters[:52] + letters[52:117] * (n % 3), k=n % 9 + 1)) for n in range(900)]
    words = [w + rng.choice(["", "", ".", ",###", "'", "|>", "\\^`~", "\n"]) for w in words]
    texts = [" ".join(rng.choices(words, k=90)) for _ in range(60)] + ["", " ", *letters, "A.<|EndOfText|>. <|endoftext|>. a<| b"]
    rows = pa.array(texts)
    parts = [encoder.encode_all(rows.slice(a, b - a)) for a, b in token_files._slices(rows)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(parts) > 5 and [n for _, sizes in parts for n in sizes] == [len(w) for w in want]
    assert [i for ids, _ in parts for i in ids] == [i for w in want for i in w]
    assert len(asked) < 400 < len(set(words))


def test_empty_tables(spark, none, tmp_path):
    assert bpe.encode_documents(none, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0
    token_files.write_token_ids(none, WORD_BPE, f"file://{tmp_path}/none")
    assert token_files.token_digest(spark, f"file://{tmp_path}/none").count() == 0


def test_plain_chunks_are_cut_as_by_the_pattern():
    both, library = bpe.Codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    chunks = ["Straße", "été,", "word.", "word...", "a×b", "a÷", "ß?!", "don't", "x;y", "ÿ:", ".", "", "ſ", "ª", "word.\n"]
    for text in [" ".join(chunks), *chunks, *(f" {c}" for c in chunks), *(f"a {c} b" for c in chunks)]:
        assert both.encode(text) == library.encode(text, add_special_tokens=False).ids
