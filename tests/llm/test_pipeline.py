"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from sedge.llm import language_id

from . import brute
from .conftest import DATA, rows_of


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = rows_of(spark.read.parquet(f"{DATA}/benchmark.parquet"), "item_id", "text")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        ins, kept = rows_of(docs, "doc_id", "text"), {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            lettered = {d for d, t in ins if any(c.isalpha() for c in t or "")}
            assert kept <= lettered and len(kept) >= 0.97 * len(lettered)
        elif name == "exact_dedup":
            assert kept == {d for d, (_, _, stays, _) in brute.exact(ins).items() if stays}
        elif name == "near_dedup":
            assert kept == {d for d, (_, _, stays) in brute.near(ins, 80).items() if stays}
        elif name == "decontamination":
            assert kept == {d for d, (_, hit, *_) in brute.leaks(ins, items).items() if not hit}
        else:
            assert kept == {d for d, _ in ins}
            assert out.columns == [*columns, "size", "source_size", "target", "taken"]
            continue
        assert out.columns == columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.where(F.col("doc_id").isin(sorted(kept))).collect()))
        docs = out


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, rows_of(whole, "doc_id", "taken"))) == sorted(map(str, rows_of(docs, "doc_id", "taken")))


def test_language_stage_is_reproducible(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (language_id.classify(x, language_id.trained_on(x)) for x in (docs.repartition(2), docs.repartition(5)))
    assert sorted(map(str, rows_of(a, "doc_id", "lang_pred", "rejected"))) == sorted(map(str, rows_of(b, "doc_id", "lang_pred", "rejected")))


def test_odd_input(spark):
    """Null ids, texts and sources, repeated rows, a very long text, other columns, no rows."""
    long_text = " ".join(f"the word {i} of a long text" for i in range(40_000))
    rows = [(None, "a text that stands alone without an id", "en", None, 1), (None, "the same text twice without an id", "en", "web", 2), (None, "the same text twice without an id", "en", "web", 2), (7, None, None, None, None)]
    rows += [(8, "", "en", "web", 0), (9, "one text of an id that comes twice", "en", "web", 3), (9, "one text of an id that comes twice", "en", "web", 3), (10, long_text, "en", "books", 4)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, size int")
    for start in (docs, docs.limit(0)):
        x = start
        for name, stage in corpus_pipeline.STAGES:
            x = stage(spark, x, DATA)
            assert x.columns[:5] == list(corpus_pipeline.COLUMNS), name
        got = sorted((r["doc_id"] or 0, r["text"][:20]) for r in x.collect())
        want = [(0, "a text that stands a"), (0, "the same text twice "), (0, "the same text twice "), (9, "one text of an id th"), (9, "one text of an id th"), (10, long_text[:20])]
        assert got == (want if start is docs else [])
