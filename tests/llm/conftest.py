import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, bits long, words int, at int, tie int"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that operators must bear: nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    words = ["the", "of", "lantern", "quiet", "über", "señal", "river", "stone,", "Ash", "42", "end."]
    passage = " ".join(rng.choice(words) for _ in range(120))
    long_ = " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(60_000))
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        "x" * 5_000,
        "a" * 199,
        "ab " * 400,
        passage,
        passage,
        "before " + passage + " after",
        passage.upper(),
        long_,
        "<|endoftext|> 'll don't   　 你好 👍🏽 \x1c\x85 é",
        "tab\tand\r\nnew   line  ",
    ]
    rows = [(n, t) for n, t in enumerate(texts)]
    rows += [(8, passage), (3, "another text of document three"), (None, "no id"), (None, passage), (-5, "minus")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows as documents with further columns whose names operators use inside."""
    full = [(i, t, None, "s", None, "x", 1, 2, None, 3) for i, t in odd_rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
