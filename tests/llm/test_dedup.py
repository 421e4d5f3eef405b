"""Near, suffix, substring and exact dedup against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import common, exact_dedup, minhash, passages, recompression, suffix_dedup

from . import brute
from .conftest import rows_of


def near(docs, percent=85):
    out = minhash.duplicate_groups(docs.select(F.col("doc_id").alias("doc"), "text"), percent)
    return {r[0]: tuple(r[1:]) for r in rows_of(out, "doc", "n_shingles", "component_id", "kept")}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, texts, percent):
    assert near(docs, percent) == brute.near(texts, percent)


def test_near_duplicates_in_a_crowd(spark):
    """A base text edited from a word up to a third of its words, many times over: large buckets, few of them one class."""
    rng = random.Random(3)
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8, 30])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert near(df) == brute.near(rows)


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"s{k}" for k in range(10, 10 + n))) for i, n in enumerate(range(5, 40))]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute.near(rows)


def test_near_duplicates_keeps_other_columns(spark):
    rows = [(1, "a b c d e f", "x", 0, 5), (1, "a b c d e f", "y", 1, 6), (None, "a b c d e f", None, None, None), (2, "a b c d e f", "z", 1, 7), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, body string, kept string, n int, key int")
    got = minhash.near_duplicates(df, id_col="id", text_col="body")
    assert got.columns == ["id", "body", "n", "key", "n_shingles", "component_id", "kept"]
    assert sorted(rows_of(got, "id", "n", "component_id", "kept"), key=str) == sorted([(1, 0, 1, True), (1, 1, 1, True), (None, None, None, True), (2, 1, 1, False), (None, None, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0), id_col="id", text_col="body").count() == 0


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_deduplicated_keeps_what_is_kept(spark, docs, monkeypatch, most):
    """Whether the ids that go are broadcast or told by a filter; null ids stay."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    x = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(None, "one two three", None, None)] * 2, docs.schema))
    want = minhash.near_duplicates(x).where("kept").select(*x.columns)
    got = minhash.deduplicated(x)
    assert got.columns == x.columns
    assert sorted(map(str, rows_of(got, "doc_id", "source"))) == sorted(map(str, rows_of(want, "doc_id", "source")))


def test_registers_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        k = int(n * share)
        x = rng.integers(0, 1 << 63, 2 * n - k, dtype=np.uint64) * np.uint64(2)
        a, b = minhash.registers(1, np.zeros(n, np.int64), np.sort(x[:n])), minhash.registers(1, np.zeros(n, np.int64), np.sort(x[n - k :]))
        assert abs(minhash.estimate(a, b, np.array([n]), np.array([n]))[0] - k / (2 * n - k)) < 0.2


def test_chance_collisions_of_registers():
    """Of disjoint sets, of equal and of very unequal sizes, as often as reckoned (with few mantissa bits)."""
    rng = np.random.default_rng(5)
    for n, m in ((2000, 2000), (2000, 60_000)):
        seen = 0
        for _ in range(60):
            x, y = (np.sort(rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)) for k in (n, m))
            a, b = minhash.registers(1, np.zeros(n, np.int64), x)[0], minhash.registers(1, np.zeros(m, np.int64), y)[0]
            seen += ((a >> 8) == (b >> 8)).sum()  # the leading zeros and two bits
        want = minhash.chance(np.array([n]), np.array([m]))[0] * (1 << (minhash.MANTISSA - 2)) * 60 * minhash.REGISTERS
        assert abs(seen - want) < 6 * want**0.5 + 0.05 * want


def test_components_of_a_long_chain(spark):
    links = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 800), (800, 850)], "a long, b long"))
    got = dict(rows_of(minhash.components(links), "node", "label"))
    assert got == {**{i: 0 for i in range(101)}, 900: 800, 800: 800, 850: 800}


def test_byte_repeats(docs, texts):
    short = [(d, t) for d, t in texts if len(t or "") < 1_000_000]
    out = suffix_dedup.repeated_bytes(docs.where("length(text) < 1000000 or text is null"))
    assert {r[0]: tuple(r[1:]) for r in rows_of(out, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")} == brute.byte_repeats(short)


def test_byte_repeats_of_one_sign(spark):
    """A text of one repeated sign keeps its first 100 bytes; longer than a stretch of parsing."""
    n = suffix_dedup.STRETCH + 1000
    df = spark.createDataFrame([(2, "q" * n), (5, "q" * 150), (1, "ab" * 60)], "doc_id long, text string")
    got = {r["id"]: (r["n_removed"], [tuple(s) for s in r["removed"]]) for r in suffix_dedup.repeated_bytes(df).collect()}
    # Starts from 1 on have an earlier equal, so all bytes but the first go; of the pair, starts from 2 on.
    assert got == {2: (n - 1, [(1, n)]), 5: (150, [(0, 150)]), 1: (118, [(2, 120)])}


@pytest.mark.parametrize("size", [8, 16, 20, 100])
def test_suffix_array(size):
    rng = random.Random(size)
    raw = bytes(rng.choice(b"ab") for _ in range(700)) + b"\xff\x00" * 60 + b"ab" * 90 + bytes(rng.randrange(256) for _ in range(200))
    at = np.array([i for i in range(len(raw) - size + 1) if rng.random() < 0.8])
    order, rank = suffix_dedup.suffix_array(np.frombuffer(raw + b"\0" * 8, np.uint8), at, size)
    assert order.tolist() == sorted(range(len(at)), key=lambda k: (raw[at[k] : at[k] + size], k))
    keys = sorted({raw[i : i + size] for i in at.tolist()})
    assert rank.tolist() == [keys.index(raw[i : i + size]) for i in at.tolist()]


def test_rolling_hash_rolls():
    """It hangs on the bytes alone, not on their place."""
    raw = np.frombuffer(b"0123456789" * 40 + b"\0" * 200, np.uint8)
    h = suffix_dedup._rolling(raw, 400)
    assert (h[:350] == h[10:360]).all() and len(set(h[:10].tolist())) == 10


def test_word_repeats(docs, texts):
    out = recompression.repeated_words(docs)
    assert {r[0]: tuple(r[1:]) for r in rows_of(out, "id", "n_words", "n_removed", "kept_sha256")} == brute.word_repeats(texts)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    """Small alphabets, runs and shared passages at all offsets."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["a", "b", "cc", "ddd"]) for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    pool += ["a " * rng.randrange(30, 80) for _ in range(3)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 5))]
        rows.append((i * 7 - 50, rng.choice([" ", "\n"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[0]: tuple(r[1:]) for r in rows_of(suffix_dedup.repeated_bytes(df), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")} == brute.byte_repeats(rows)
    assert {r[0]: tuple(r[1:]) for r in rows_of(recompression.repeated_words(df), "id", "n_words", "n_removed", "kept_sha256")} == brute.word_repeats(rows)


def test_repeats_with_large_families(spark, monkeypatch):
    """Cores with more entries than are compared in one row, and the same in small families."""
    rng = random.Random(11)
    common_part = " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(60):
        w = common_part.split()
        if i % 3:
            w[rng.randrange(60)] = f"e{i}"
        rows.append((i, f"{'x' * (i % 7)}{i} " + " ".join(w[rng.randrange(8) :]) + f" {i}{'y' * (i % 5)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.byte_repeats(rows), brute.word_repeats(rows)
    for most in (2, 128):
        monkeypatch.setattr(passages, "FAMILY", most)
        assert {r[0]: tuple(r[1:]) for r in rows_of(suffix_dedup.repeated_bytes(df), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")} == want[0]
        assert {r[0]: tuple(r[1:]) for r in rows_of(recompression.repeated_words(df), "id", "n_words", "n_removed", "kept_sha256")} == want[1]


def test_repeats_with_null_and_repeated_ids(spark):
    p = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(None, p, 1), (3, p, 2), (3, p, 3), (4, None, None)], "doc_id long, text string, spans int")
    n = len(p)
    assert sorted((r["id"] or 0, r["n_removed"]) for r in suffix_dedup.repeated_bytes(df).collect()) == [(0, 0), (3, 0), (3, 0), (4, 0)]
    assert sorted((r["id"] or 0, r["n_removed"]) for r in recompression.repeated_words(df).collect()) == [(0, 0), (3, 40), (3, 40), (4, 0)]
    assert n > 100
    for f in (suffix_dedup.repeated_bytes, recompression.repeated_words):
        assert f(df.limit(0)).count() == 0
        assert f(df.where("text is null")).count() == 1


def test_exact_groups(docs, texts):
    got = exact_dedup.exact_groups(docs)
    assert got.columns == [*docs.columns, "keep_id", "group_size", "kept", "text_sha256"]
    assert {r[0]: tuple(r[1:]) for r in rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256")} == brute.exact(texts)


def test_exact_groups_at_the_edges(spark):
    rows = [(1, "a", "k"), (1, "a", "l"), (None, "a", "m"), (None, "b", None), (None, "b", None), (7, None, "n"), (9, "", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(0, "a", 1, 3, False), (0, "b", 0, 2, True), (0, "b", 0, 2, True), (1, "a", 1, 3, True), (1, "a", 1, 3, True), (7, "", 9, 2, False), (9, "", 9, 2, True)]
    least = exact_dedup.exact_groups(df.where("doc_id > 1"), keep="smallest")
    assert {r["doc_id"]: r["kept"] for r in least.collect()} == {7: True, 9: False}
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    twice = keys.union(keys.where("k % 7 = 0")).repartition(6)
    filt = common.build_bloom(twice, common.bits_for(20_000), repeated=True)
    again = np.array([r["k"] for r in keys.where("k % 7 = 0").collect()], np.int64)
    assert common.bloom_has(filt, again).all()
    alone = np.array([r["k"] for r in keys.where("k % 7 <> 0").collect()], np.int64)
    assert common.bloom_has(filt, alone).mean() < 0.2


def test_long_texts_are_cut_between_words():
    rng = random.Random(5)
    for most in (40, 300):
        raw = b" ".join(b"w" * rng.choice([1, 2, 5, 90]) + str(i).encode() for i in range(400)) + b" "
        words, seen = raw.split(), []
        for before, piece in recompression.cut_long(raw, most):
            part = piece.split()
            assert part == words[before : before + len(part)]
            seen += range(before, before + len(part) - recompression.SIZE + 1)
        assert seen == list(range(len(words) - recompression.SIZE + 1))


def test_recompression_rounds(spark):
    """Rounds by hand on one text: the symbols spell its words, none is too long, and equal strings have equal inner symbols."""
    rng = random.Random(6)
    inner = [f"i{k}" for k in range(300)]
    texts = [" ".join([f"a{rng.randrange(9)}" for _ in range(rng.randrange(5, 90))] + inner + [f"b{rng.randrange(9)}" for _ in range(50)]) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    state = recompression.recompress(recompression.stretches(df))
    rows, shared = {r["doc"]: r for r in state.collect()}, []
    for d, t in enumerate(texts):
        r, at = rows[d], r"first"
        sizes, names = np.frombuffer(r["sizes"], np.uint8), np.frombuffer(r["names"], np.uint64)
        assert sizes.sum() == len(r["text"].split()) and sizes.max() <= 64 and np.frombuffer(r["core_sizes"], np.uint8).max() <= 8
        start = t.split().index("i0") - r[at]
        ends = np.cumsum(sizes)
        inside = (ends - sizes >= start + 66) & (ends <= start + 300 - 66)
        shared.append(names[inside].tolist())
    assert shared[0] == shared[1] == shared[2] and len(shared[0]) > 2


def test_recompression_registry(spark):
    """Each pair of a round once, with its count; a second meaning of a name would start the rounds anew."""
    df = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(80))), (2, " ".join(f"k{i}" for i in range(80)))], "doc long, text string")
    words = recompression.stretches(df)
    got = recompression.registry(words, 1).collect()
    assert got and len({r["name"] for r in got}) == len(got)
    assert all(r["n"] == 2 and r["left"] == r["_left"] and r["right"] == r["_right"] for r in got)
