"""What passages.py asks of a parser, at random: each window in one phrase, equal windows and no others alike."""

import gc
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sedge.llm import passages, recompression, suffix_dedup

from . import brute



def byte_rows(texts, rng, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", rng.choice((1 << 20, 50, 300)))
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "text": texts})
    return suffix_dedup.parse(batch), list(range(len(texts)))


def word_rows(texts, rng, monkeypatch):
    """Pieces of the texts as stretches, their symbols after all rounds."""
    pieces = [(d, *piece) for d, t in enumerate(texts) for piece in recompression.cut_long(t.encode(), rng.choice((1 << 18, 60, 400)))]
    data = pa.array([raw for _, _, raw in pieces], pa.binary())
    _, names, row, _, _ = recompression._hashed(data)
    sizes, kept = np.ones(len(names), np.uint8), {}
    for r in range(recompression.LEVELS + 1):
        names, sizes, row = recompression.renamed(names, sizes, row, r)
        if r == recompression.CORE:
            kept = {"core": recompression._packed(names, row, len(pieces)), "core_sizes": recompression._packed(sizes, row, len(pieces))}
    kept |= {"names": recompression._packed(names, row, len(pieces)), "sizes": recompression._packed(sizes, row, len(pieces))}
    batch = pa.RecordBatch.from_pydict({"doc": [d for d, _, _ in pieces], "first": [n for _, n, _ in pieces], "text": data, **kept})
    look_everywhere = np.full(1 << 13, 255, np.uint8)
    return [recompression._parse(batch, look_everywhere)], [d for d, _, _ in pieces]


PARSERS = {"bytes": (suffix_dedup, lambda t: list(t.encode()), byte_rows), "words": (recompression, brute.WORD.findall, word_rows)}


@pytest.mark.parametrize("kind", PARSERS)
def test_windows_of_phrases(kind, monkeypatch):
    module, units, rows = PARSERS[kind]
    for seed in range(40):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(50, 200))) for _ in range(5)]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 5))) for _ in range(rng.choice([1, 6]))]
        parsed, of = rows(texts, rng, monkeypatch)
        names, places = {}, set()
        for p, finer, contents in parsed:
            if not len(p.row):
                continue
            for q in (p, finer(np.arange(len(p.row)))):
                parts = contents(q.a, q.b, q.row)
                own, place, f = module.prints(parts)
                assert Counter(own.tolist()) == Counter(dict(enumerate((q.b - q.a + 1).tolist())))
                assert q is p or (q.b - q.a < module.WIDTH).all()
                for i, s, h in zip(own.tolist(), place.tolist(), f.tolist(), strict=True):
                    r, start = of[int(q.row[i])], int(q.a[i]) + s
                    window = tuple(units(texts[r])[start : start + module.SIZE])
                    assert window == tuple(units(bytes(parts[i]).decode())[s : s + module.SIZE])
                    assert names.setdefault((q is p, window), (int(q.g[i]), h)) == (int(q.g[i]), h)
                    if q is p:
                        assert (r, start) not in places
                        places.add((r, start))
                whole = {}  # equal content keys stand for equal contents
                for i in range(len(q.row)):
                    assert whole.setdefault((int(q.g[i]), int(q.c[i])), units(bytes(parts[i]).decode())) == units(bytes(parts[i]).decode())
        assert places == {(r, i) for r, t in enumerate(texts) for i in range(len(units(t)) - module.SIZE + 1)}
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("sort", [suffix_dedup.by_suffix, recompression.by_print])
def test_sorted_windows(sort):
    """Classes of equal windows, and an order by class in which equal windows stand as they came."""
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["a", "bb", "c"]) for _ in range(60)) for _ in range(4)]
    parts = [(rng.choice(pool) + " " + rng.choice(pool))[rng.randrange(4) * 2 :].encode() for _ in range(25)] + [b"", b"short"]
    own, at, names, order = sort(parts)
    unit = [list(p) if sort is suffix_dedup.by_suffix else p.split() for p in parts]
    size = suffix_dedup.SIZE if sort is suffix_dedup.by_suffix else recompression.SIZE
    windows = [tuple(unit[i][s : s + size]) for i, s in zip(own.tolist(), at.tolist(), strict=True)]
    assert len(windows) == sum(max(0, len(u) - size + 1) for u in unit) and len(set(zip(windows, names.tolist(), strict=True))) == len(set(windows)) == len(set(names.tolist()))
    assert sorted(order.tolist()) == list(range(len(windows)))
    for i, j in zip(order.tolist(), order.tolist()[1:], strict=False):
        assert names[i] < names[j] or (names[i] == names[j] and i < j)
        if sort is suffix_dedup.by_suffix:
            assert windows[i] <= windows[j]


def test_merged_spans_cover_the_same():
    for seed in range(50):
        rng = np.random.default_rng(seed)
        row, a = np.sort(rng.integers(0, 4, 30)), rng.integers(0, 300, 30)
        a = a[np.lexsort((a, row))]
        o = np.lexsort((a, row))
        row, a = row[o], a[o]
        b = a + rng.integers(0, 9, 30)
        cover = lambda r, x, y: {(k, i) for k, s, e in zip(r, x, y, strict=True) for i in range(s, e + 10)}
        merged = passages.merge_spans(row, a, b, 10)
        assert cover(*merged) == cover(row, a, b) and len(merged[0]) < 30


def test_contents_of_bytes_let_go_of_texts():
    """Members of op2 are made into Arrow columns; the texts that they were cut from go afterwards."""
    rng = random.Random(3)
    batch = pa.RecordBatch.from_pydict({"text": ["".join(rng.choices("abcdef ", k=300_000))]})

    def work():
        for p, _, contents in suffix_dedup.parse(batch):
            assert pa.array(contents(p.a, p.b, p.row), pa.binary()).null_count == 0
        gc.collect()

    work()
    tracemalloc.start()
    try:
        work()
        before = tracemalloc.get_traced_memory()[0]
        work()
        assert tracemalloc.get_traced_memory()[0] - before < 100_000
    finally:
        tracemalloc.stop()
