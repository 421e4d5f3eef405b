import random

import pytest

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, tied, very long, non-ASCII, in order of their ids from 1_000_000 on."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(400)}" for _ in range(60_000)]
    passage = " ".join(f"p{i}" for i in range(50))
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "one", "One", "two words", "two words", "a a a a a a a a a a a a " * 20, "a " * 300, " ".join(words), " ".join(words[:30_000]) + " end " + passage,
        passage, f"{passage} tail", f"ÉÉ é  x {passage}", "\U0001f600" * 90, "x" * 5000, "x" * 5000, "y" * 99, "y" * 100, "z" * 250, "\0 \x01 \x7f ~", "ab " * 34, "q" * 3_000_000 + " end", "one two three four five six", "one two three four five six seven",
    ]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """The driver's documents and the odd ones."""
    odd = [(1_000_000 + i, t, None if i % 3 else "en", None if i % 2 else "web") for i, t in enumerate(odd_texts)]
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
