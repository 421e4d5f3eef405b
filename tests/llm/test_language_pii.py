"""Language identification by held-out accuracy, personal data by brute force of the base patterns."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import language_id, pii

from . import brute
from .conftest import DATA, rows_of


def test_held_out_accuracy(spark):
    out = language_id.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    rows = [r for r in rows_of(out, "doc_id", "held_out", "lang_pred", "lang", "score", "text")]
    assert all(h == brute.held_out(d) for d, h, *_ in rows)
    assert all(0 <= s <= 1 for *_, s, _ in rows)
    told = [(p, lang) for _, h, p, lang, _, t in rows if h and lang and re.search(r"[^\W\d_]", t or "")]
    assert len(told) > 20 and sum(p == lang for p, lang in told) / len(told) > 0.95
    assert {p for _, _, p, *_ in rows} <= {lang for *_, lang, _, _ in rows} | {"und"}


def test_language_of_odd_texts(spark, docs, odd_texts):
    model = language_id.trained_on(docs)
    out = language_id.classify(docs.where("doc_id >= 1000000").withColumn("score", F.lit("mine")), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"]
    got = {r["doc_id"] - 1_000_000: r for r in out.collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        letter = bool(re.search(r"[^\W\d_]", t or ""))
        assert (got[i]["lang_pred"] == "und") == (not letter)
        assert letter or (got[i]["score"] == 0 and got[i]["rejected"])


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "hello there", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language_id.trained_on(df) is None
    assert {r["lang_pred"] for r in language_id.classify(df, None).collect()} == {"und"}
    assert language_id.classify(df.limit(0), None).count() == 0


def test_counts_of_a_long_text_add_up():
    t = ("der Hund läuft schnell. " * 100_000).encode()
    (i, c), *rest = language_id.vectors([t])
    assert i == 0 and not rest
    one = language_id.count_grams([t[:2400]])
    a, b = language_id.normalise(c), language_id.normalise(one)
    assert float((a * b).sum()) > 0.999


def test_counts_do_not_hang_on_pieces(monkeypatch):
    """A text without blanks, and one with, in pieces and whole."""
    rng = np.random.default_rng(1)
    for t in (bytes(rng.integers(97, 123, 5000, dtype=np.uint8)), b"ab c  d. " * 700 + "é".encode() * 90):
        whole = language_id.count_grams([t])
        monkeypatch.setattr(language_id, "_PIECE", 37)
        ((i, c),) = language_id.vectors([t])
        monkeypatch.undo()
        assert i == 0 and np.array_equal(c, whole)


def plain_counts(text):
    """N-grams of a text by hand: 1 to 3 folded bytes, of blanks only single ones beside a sign."""
    b = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + b" "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            if b"  " in g or g == b" ":
                continue
            code = 0
            for c in g:
                code = ((code * 0x01000193) & 0xFFFFFFFF) ^ c
            h = (code * 0x9E3779B1 + n * 0x85EBCA6B) & 0xFFFFFFFF
            out[((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19] += 1
    return out


def test_prediction_by_hand(spark, docs):
    """Vectors, cosines, languages, scores and rejections of some texts in plain Python, from the model's centroids."""
    model = language_id.trained_on(docs)
    some = docs.where("doc_id % 9 = 0 and length(text) < 4000").select("doc_id", "text")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in language_id.classify(some, model).collect()}
    told = 0
    for d, t in rows_of(some, "doc_id", "text"):
        if not re.search(r"[^\W\d_]", t):
            continue
        counts = plain_counts(t)
        v = {k: n**0.5 * float(model.idf[k]) for k, n in counts.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * float(c[k]) for k, x in v.items()) / size if size else 0.0 for c in model.centroids]
        best = max(range(len(cos)), key=lambda i: cos[i])
        length = sum(n >= at for at in language_id.LENGTHS for n in [sum(counts.values())])
        lang, score, rejected = got[d]
        assert abs(score - max(0, min(1, cos[best]))) < 1e-4
        if sorted(cos)[-1] - sorted(cos)[-2] > 1e-4:
            assert lang == model.langs[model.owner[best]]
            told += 1
        if abs(cos[best] - model.limit[best][length]) > 1e-4:
            assert rejected == (cos[best] < model.limit[best][length])
    assert told > 15


def test_k_means_by_hand():
    rng = np.random.default_rng(3)
    x = language_id.normalise(rng.random((60, 8)).astype(np.float32))
    got = language_id.k_means(x, 3, 7)
    c = x[np.random.default_rng(7).choice(60, 3, replace=False)]
    for _ in range(12):
        groups = [[] for _ in c]
        for v in x:
            groups[max(range(len(c)), key=lambda i: float(v @ c[i]))].append(v)
        sums = [np.sum(g, axis=0) if g else c[i] for i, g in enumerate(groups)]
        c = np.array([v / np.linalg.norm(v) for v in sums])
    assert np.allclose(got, c, atol=1e-4)


def test_rejection_by_distance(spark, docs):
    """Long texts of languages that were not learned go, short clean ones stay."""
    other = {
        "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. Ahi quanto a dir qual era e cosa dura questa selva selvaggia e aspra e forte",
        "fi": "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa.",
        "code": "def f(x):\n    return [i*i for i in range(x) if i % 2 == 0]\nclass A(object):\n    def __init__(self, value):\n        self.value = value\n",
    }
    rows = [(i, k, " ".join([t] * 10)) for i, (k, t) in enumerate(other.items())]
    model = language_id.trained_on(docs)
    assert all(r["rejected"] for r in language_id.classify(spark.createDataFrame(rows, "doc_id long, k string, text string"), model).collect())
    clean = docs.where("doc_id < 1000000 and lang is not null and length(text) between 40 and 400")
    got = language_id.classify(clean, model).collect()
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def test_sample_keeps_its_bound(spark):
    """As many languages as rows: the most frequent are learned, a row or so of each."""
    rows = [(i, f"some words of text number {i}", f"l{i % 90:02}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample=45)
    assert len(model.centroids) <= 200
    few = language_id.LANGUAGES
    try:
        language_id.LANGUAGES = 5
        assert language_id.fit(df).langs == [f"l{i:02}" for i in range(5)]
    finally:
        language_id.LANGUAGES = few


def test_same_model_whatever_the_partitions(docs):
    a, b = (language_id.trained_on(docs.repartition(n)) for n in (1, 7))
    assert np.array_equal(a.centroids, b.centroids) and np.array_equal(a.idf, b.idf)


TRICKY = [
    "a@b.c a@b@c.d x..y@z-1.w.v. @no me@here me@here. 1@2.3",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.0255.000255.9 1.2.3 ....1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 411111111111111 0000000000000 1234567890123456789012",
    "+1 (202) 555-0100 +12 345 678 9 +1 +-- ++44.20.7946.0958 +123456789 0123456789 +1)2",
    "tel+49 30 1234567890,4111111111111111 é😀 a.b@c.de😀+331234567890",
    "٣.٤.٥.٦ ٤١١١١١١١١١١١١١١١ +١٢٣٤٥٦٧٨٩٠ a@ß.de ä@b.cd",
    "1.2.3.4\n4111 1111\n1111 1111 +1\n2025550100",
]


def base_of(text):
    spans = brute.personal(text or "")
    n = [sum(k == i for _, k, _ in spans) for i in range(4)]
    return (*n, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())


def test_base_spans():
    for t in TRICKY:
        assert [(a, k, b) for a, k, b in pii.base_spans(t)] == brute.personal(t), t


def test_personal_data(spark, docs, texts):
    got = pii.find(docs, pii.train(docs))
    assert got.columns == [*docs.columns, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {r["doc_id"]: r for r in got.collect()}
    for d, t in texts:
        r = rows[d]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == base_of(t)
        every = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert every == sorted(every) and set(brute.personal(t or "")) <= set(every)
        assert all(0 <= a < b <= len(t) for a, _, b in every)
        more = [s for s in every if s not in brute.personal(t or "")]
        assert all(b <= x or y <= a for a, _, b in more for x, _, y in brute.personal(t or ""))


def test_consistency_along_skip_links(docs):
    """A number that is marked once is found where it stands without its sign; without the mark it is not."""
    field = pii.train(docs)
    t = "call +44 20 7946 0958 or +442079460958 now . " + "word " * 40 + "again 442079460958 please"
    base = pii.base_spans(t)
    assert len(base) == 2
    x, spans = pii.features(t, pii.nodes(t)).astype(float), pii.nodes(t)
    given, chain = pii.node_labels(spans, base), pii.chain_links(t, spans)
    linked, alone = field.marginals(x, chain, pii.skip_links(t, spans), given), field.marginals(x, chain, [], given)
    assert linked[-1][4] > alone[-1][4] and linked[-2][4] > 0.99


def test_marginals_match_enumeration():
    """On a chain and a tree loopy messages are exact."""
    rng = np.random.default_rng(1)
    u, chain, skip = rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    chain, skip = chain + chain.T, skip + skip.T
    f, x = pii.Field(u, chain, skip), rng.normal(size=(4, 3))
    p = f.marginals(x, [(0, 1), (1, 2)], [(0, 3)])
    want = np.zeros((4, 5))
    s = x @ u
    for i in range(5**4):
        y = [i // 5**k % 5 for k in range(4)]
        w = np.exp(sum(s[k, y[k]] for k in range(4)) + chain[y[0], y[1]] + chain[y[1], y[2]] + skip[y[0], y[3]])
        for k in range(4):
            want[k, y[k]] += w
    assert np.allclose(p, want / want.sum(1, keepdims=True), atol=2e-3)


def test_pii_at_the_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a@b.cd", None), (None, "a@b.cd", None)], "doc_id long, text string, spans string")
    got = pii.find(df, pii.train(df))
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in got.collect()) == [(0, 1, "email:0:6"), (0, 1, "email:0:6"), (1, 0, ""), (2, 0, "")]
    empty = df.limit(0)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_similar_mentions_are_linked():
    t = "see mailto:X@y.zz, or <x@y.zz>; +49 30 1234567 is 0301234567 as well, not 7654321"
    spans = pii.nodes(t)
    words = [t[a:b] for a, b in spans]
    links = {(words[i], words[j]) for i, j in pii.skip_links(t, spans)}
    assert ("mailto:X@y.zz,", "<x@y.zz>;") in links and ("1234567", "0301234567") in links
    assert not any("7654321" in pair for pair in links)


def test_the_word_before_tells(spark):
    """Numbers of one shape, which stand after `phone:` if they are personal and after `order` if they are not."""
    rows = [(i, f"a text, phone: +{10_000_000_000 + i} and order {20_000_000_000 + i} here") for i in range(400)]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    t = "my phone: 30000000001 and order 30000000002"
    p = field.marginals(pii.features(t, pii.nodes(t)).astype(float), [], [])
    assert p[0][4] > 0.7 and p[1][4] < 0.1
