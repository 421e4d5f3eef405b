"""Substring dedup by recompression.

Words are the first symbols. Each round is a pass of Spark over all sequences: round 0 names runs of equal symbols, each
later one pairs of neighbours, where a left symbol meets a right one, sides being a bit of the symbol's name in that round.
A round has two jobs. The first gathers what is named anywhere into the round's registry, which has each name once and
counts it; a name is a fingerprint of what it stands for, and the registry proves it to stand for one thing only (else all
rounds start anew with another seed). So equal strings have equal symbols in all documents. The second puts the names in.

Rounds are restricted as in the restricted form of recompression: in round r only symbols of at most 2**(r-1) words are
joined, so symbols have at most 2**r words, and what stands outside a string can change its parse only in its outer words: 3
for a run cut by the edge (longer runs stay apart), then 1, 2, 4 and so on for the rounds. CORE rounds make symbols of at
most 8 words, of which each window of 35 words holds a whole one within MARGIN words of its ends; the one with the least hash
is the window's. Windows with the same symbol form a phrase, whose core is the symbol with MARGIN words at both sides; equal
cores reveal repeats, and equal windows verify them (passages.py). Further rounds, up to LEVELS, make symbols of up to 64
words. One of 35 or more that occurs again is a repeat as it stands, all its windows with it; only its first occurrence is
looked into again, for windows that stand elsewhere too.

Rounds only see stretches that may hold a repeated window: each window has an 18-word string that is picked by least hash, and
a filter tells those that surely occur once. Long texts are cut into pieces that overlap by 34 words.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .passages import Parsed, Phrases, covered, finer, fold, place, repeats, with_spans

SIZE, CORE, LEVELS, RUN, MARGIN, WIDTH, GRAM = 35, 3, 6, 3, 10, 5, 18
_K = np.uint64(0xD6E8FEB86659FD93)
#: A position within the words or symbols worked on at once, which are fewer.
_LOW = np.uint64((1 << 24) - 1)
#: What a task has named is made distinct about so many at a time.
_NAMED = 1 << 19
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def cut_long(raw: bytes, most: int = tokens.PIECE) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece) of a text: about `most` bytes each, cut at blanks, with SIZE - 1 words in common, so that
    each window lies in one piece."""
    k = before = 0
    while True:
        e = k + most
        while True:
            gap = _BLANK.search(raw, e) if e < len(raw) else None
            e = gap.start() if gap else len(raw)
            start, _ = tokens.words(np.frombuffer(raw[k:e] + b"\0" * 8, np.uint8))
            if len(start) >= SIZE or e == len(raw):
                break
            e += most  # very long words
        yield before, raw[k:e]
        if e == len(raw):
            return
        before += len(start) - SIZE + 1
        k += int(start[1 - SIZE])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """doc, words before it and text of pieces, some at a time."""
    for b in batches:
        doc, text = b.column("doc").to_numpy(zero_copy_only=False), b.column("text").cast(pa.binary())
        for i, j in tokens.pieces(text):
            if j == i + 1 and text[i].is_valid and len(text[i].as_buffer()) > 2 * tokens.PIECE:
                for before, raw in cut_long(text[i].as_buffer().to_pybytes()):
                    yield doc[i:j], np.array([before]), pa.array([raw], pa.binary())
            else:
                yield doc[i:j], np.zeros(j - i, np.int64), text.slice(i, j - i)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Places of the least (leftmost of equals) of `width` values from each place on."""
    m = np.concatenate([(x & ~_LOW) | np.arange(len(x), dtype=np.uint64), np.full(width, ~np.uint64(0))])
    w = 1
    while w * 2 <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return (np.minimum(m[: len(m) - (width - w)], m[width - w :])[: len(x)] & _LOW).astype(np.int64)


def _starts(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n texts starts among words of these rows (and the end); the words at which a window starts."""
    first = np.searchsorted(row, np.arange(n + 1))
    return first, np.flatnonzero(np.arange(len(row)) + SIZE <= first[1:][row]) if len(row) else np.zeros(0, np.int64)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of GRAM consecutive values from each place on."""
    width = 1
    while width < GRAM:
        step = min(width, GRAM - width)
        h = common.mix64(h[:-step] * _K + h[step:]) if len(h) > step else h[:0]
        width += step
    return h


def _picked(text: pa.Array) -> tuple:
    """The words of the texts (_hashed), window starts, place and hash of each window's picked string."""
    found = _hashed(text)
    _, s = _starts(found[2], len(text))
    x = _grams(found[1])
    at = _least(x, SIZE - GRAM + 1)[s] if len(s) else s
    return *found, s, at, x


def stretches(docs: DataFrame) -> DataFrame:
    """doc, first (words before it), text and names of its words: the stretches of docs (doc, text) that may hold a repeat."""

    def keys(b: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for _, _, text in _pieces(iter([b])):
            *_, at, x = _picked(text)
            out.append(x[np.unique(at)])
        return np.concatenate(out)

    spark = docs.sparkSession
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again = spark.sparkContext.broadcast(common.build_bloom(docs, common.bits_for(words // 40, per_key=16), repeated=True, key=keys))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, before, text in _pieces(batches):
            data, h, row, begin, end, s, at, x = _picked(text)
            s = s[common.bloom_has(again.value, x[at])] if len(s) else s
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] > s[:-1] + SIZE) | (row[s[1:]] != row[s[:-1]])
            f = np.flatnonzero(new)
            a, e = s[f], s[np.concatenate([f[1:], [len(s)]]) - 1] + SIZE
            first = np.searchsorted(row, np.arange(len(text)))
            own = row[a]
            raw, names = data.data, h.tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc": doc[own], "first": before[own] + a - first[own], "text": pa.array([raw[i:j] for i, j in zip(begin[a].tolist(), end[e - 1].tolist(), strict=True)], pa.binary()),
                "names": pa.array([names[8 * i : 8 * j] for i, j in zip(a.tolist(), e.tolist(), strict=True)], pa.binary()), "sizes": pa.array([b"\1" * k for k in (e - a).tolist()], pa.binary()),
            })

    return common.materialize(docs.mapInArrow(common.frugal(cut), "doc long, first long, text binary, names binary, sizes binary"), "rec-words")


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed arrays; the row of each."""
    count = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.repeat(np.arange(len(column)), count)


def _packed(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1)) * values.itemsize
    raw = values.tobytes()
    return pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def joins(names: np.ndarray, size: np.ndarray, row: np.ndarray, r: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What round r names: first place, number of symbols, name, and what stands beside the first: the run's length or the
    pair's right symbol."""
    if r == 0:
        head = np.ones(len(names), bool)
        head[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(head)
        count = np.diff(np.concatenate([first, [len(names)]]))
        some = (count > 1) & (count <= RUN)
        first, count = first[some], count[some]
        other = count.astype(np.uint64)
    else:
        right = (common.mix64(names + np.uint64(r)) >> np.uint64(63)).astype(bool)
        active = size <= 1 << (r - 1)
        first = np.flatnonzero(~right[:-1] & right[1:] & active[:-1] & active[1:] & (row[:-1] == row[1:]))
        count, other = np.full(len(first), 2), names[first + 1] if len(first) else np.zeros(0, np.uint64)
    return first, count, common.mix64(common.mix64(names[first] * _K + np.uint64(r + 64 * seed)) + other), other


def renamed(names: np.ndarray, size: np.ndarray, row: np.ndarray, r: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences after round r."""
    first, count, made, _ = joins(names, size, row, r, seed)
    names, size, keep = names.copy(), size.copy(), np.ones(len(names), bool)
    names[first] = made
    for i in range(1, RUN):
        at = first[count > i]
        size[at] += size[at + i]
        keep[at + i] = False
    return names[keep], size[keep], row[keep]


def registry(state: DataFrame, r: int, seed: int = 0) -> DataFrame:
    """name, left, right, n of all that round r names, once each, over all sequences."""

    def once(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        name, left, right = map(np.concatenate, zip(*parts, strict=True))
        name, at, n = np.unique(name, return_index=True, return_counts=True)
        return pa.RecordBatch.from_pydict({"name": name.view(np.int64), "left": left[at].view(np.int64), "right": right[at].view(np.int64), "n": n})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for b in batches:
            (names, row), (size, _) = _values(b.column("names"), np.uint64), _values(b.column("sizes"), np.uint8)
            first, _, name, other = joins(names, size, row, r, seed)
            parts.append((name, names[first], other))
            total += len(name)
            if total >= _NAMED:
                yield once(parts)
                parts, total = [], 0
        if total:
            yield once(parts)

    found = state.select("names", "sizes").mapInArrow(common.frugal(made), "name long, left long, right long, n long")
    return found.groupBy("name").agg(F.min("left").alias("left"), F.max("left").alias("_left"), F.min("right").alias("right"), F.max("right").alias("_right"), F.sum("n").alias("n"))


def recompress(words: DataFrame, seed: int = 0) -> DataFrame | None:
    """doc, first, text, core and core_sizes (the symbols after CORE rounds), names and sizes (those after all); None if a name
    has two meanings. The tables of earlier rounds, that of the words too, go as soon as the next is there."""
    state = words
    for r in range(LEVELS + 1):
        clash = registry(state, r, seed).where("left <> _left or right <> _right").limit(1).count()
        common.release(words.sparkSession)
        if clash:
            common.discard(state)
            return None

        def put(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            for b in batches:
                (names, row), (size, _) = _values(b.column("names"), np.uint64), _values(b.column("sizes"), np.uint8)
                names, size, row = renamed(names, size, row, r, seed)
                new = {"names": _packed(names, row, b.num_rows), "sizes": _packed(size, row, b.num_rows)}
                kept = [c for c in b.schema.names if c not in new]
                if r == CORE:
                    new |= {"core": new["names"], "core_sizes": new["sizes"]}
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new.values()], [*kept, *new])

        kept = [c for c in state.columns if c not in ("names", "sizes")]
        schema = ", ".join(["doc long, first long", *(f"{c} binary" for c in kept[2:]), "names binary, sizes binary", *["core binary, core_sizes binary"] * (r == CORE)])
        after = common.materialize(state.select(*kept, "names", "sizes").mapInArrow(common.frugal(put), schema), f"rec-{r}")
        common.discard(state)
        state = after
    return state


def long_symbols(state: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """Symbols of SIZE or more words: (name, doc, a, b: its first and last window); name, n, fd, fa (the first occurrence)
    of each; a filter of the places that are to be looked into."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (names, row), (size, _) = _values(b.column("names"), np.uint64), _values(b.column("sizes"), np.uint8)
            start = _begin(size, row) + b.column("first").to_numpy()[row]
            k = np.flatnonzero(size >= SIZE)
            yield pa.RecordBatch.from_pydict({"name": names[k].view(np.int64), "doc": b.column("doc").to_numpy()[row[k]], "a": start[k], "b": start[k] + size[k] - SIZE})

    spark = state.sparkSession
    seen = common.materialize(state.select("doc", "first", "names", "sizes").mapInArrow(common.frugal(named), "name long, doc long, a long, b long"), "rec-long")
    entries = common.materialize(seen.groupBy("name").agg(F.min(F.struct("doc", "a")).alias("m"), F.count(F.lit(1)).alias("n")).select("name", "n", F.col("m.doc").alias("fd"), F.col("m.a").alias("fa")), "rec-entries")
    once = common.build_bloom(entries.select("fd", "fa"), common.bits_for(entries.count()), key=lambda b: place(b.column("fd").to_numpy(), b.column("fa").to_numpy()))
    return seen, entries, spark.sparkContext.broadcast(once)


def _begin(size: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words of the row before each symbol."""
    end = np.cumsum(size.astype(np.int64))
    start = end - size
    return start - start[np.searchsorted(row, row)] if len(row) else start


def _fold_words(h: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    def parts() -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        least = int(size.min()) if len(size) else 0
        for k in range(int(size.max()) if len(size) else 0):
            if k < least:
                yield None, h[start + k]
            else:
                i = np.flatnonzero(size > k)
                yield i, h[start[i] + k]

    return fold(parts(), seed)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts; hash, text and place in the bytes of each word."""
    data, at = tokens.joined(texts)
    begin, end = tokens.words(data)
    return data, tokens.word_hashes(data, begin, end), np.searchsorted(at, begin, "right") - 1, begin, end


def _parse(rows: pa.RecordBatch, looked_into: np.ndarray) -> Parsed:
    """Phrases of stretches; those whose windows all lie in a long symbol that stands elsewhere too are left out, but for the
    symbol's first occurrence."""
    data, h, row, begin, end = _hashed(rows.column("text"))
    n, before = len(h), rows.column("first").to_numpy()
    first_word, s = _starts(row, rows.num_rows)
    (names, of), (size, _) = _values(rows.column("core"), np.uint64), _values(rows.column("core_sizes"), np.uint8)
    start = _begin(size, of) + first_word[of]
    symbols = np.zeros(n + 2, np.int64)  # symbols that start before a word
    symbols[start + 1] = 1
    symbols = np.cumsum(symbols)
    lo, hi = symbols[s + MARGIN], symbols[s + SIZE - MARGIN + 1] - 1  # whole symbols lo..hi-1
    # The least hash among them, leftmost of equals, by a table of minima over 1, 2, 4, 8 symbols.
    x = (common.mix64(names) & ~_LOW) | (np.arange(len(names), dtype=np.uint64) & _LOW)
    mins = [x]
    for k in range(3):
        m = mins[-1].copy()
        if len(m) > 1 << k:
            m[: -(1 << k)] = np.minimum(mins[-1][: -(1 << k)], mins[-1][1 << k :])
        mins.append(m)
    table = np.stack(mins) if len(names) else np.zeros((4, 0), np.uint64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    left = np.minimum(table[level, lo], table[level, hi - (1 << level)]) if len(s) else np.zeros(0, np.uint64)
    own = (left & _LOW).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)
    f = np.flatnonzero(new)
    a, b, own = s[f], s[np.concatenate([f[1:], [len(s)]]) - 1] if len(s) else s[f], own[f]

    (_, whose), (large, _) = _values(rows.column("names"), np.uint64), _values(rows.column("sizes"), np.uint8)
    inside = _begin(large, whose)
    sym = np.searchsorted(inside + first_word[whose], a, "right") - 1
    known = (large[sym] >= SIZE) & (b + SIZE <= inside[sym] + first_word[whose[sym]] + large[sym])
    known[known] = ~common.bloom_has(looked_into, place(rows.column("doc").to_numpy()[whose[sym[known]]], (inside[sym] + before[whose[sym]])[known]))
    a, b, own = a[~known], b[~known], own[~known]

    stops = np.concatenate([start, [n]])
    t, e = stops[own], stops[own + 1] if len(own) else own
    core = _fold_words(h, t - MARGIN, e - t + 2 * MARGIN, common.mix64((e - t).astype(np.uint64)))
    c = _fold_words(h, a, b - a + SIZE, common.mix64((t - a).astype(np.uint64)))
    shift = before[row[a]] - first_word[row[a]]

    def read(start: np.ndarray, size: np.ndarray, seed: np.ndarray, of: np.ndarray) -> np.ndarray:
        return _fold_words(h, start + first_word[of] - before[of], size, seed)

    def contents(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> list[bytes]:
        back = first_word[of] - before[of]
        return [raw[i:j] for i, j in zip(begin[a + back].tolist(), end[b + back + SIZE - 1].tolist(), strict=True)]

    raw, phrases = data.data, Phrases(row[a], a + shift, b + shift, core, c)
    return phrases, lambda k: finer(k, phrases, t + shift, SIZE, WIDTH, read), contents


def prints(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, h, row, _, _ = _hashed(pa.array(contents, pa.binary()))
    first = np.searchsorted(row, np.arange(len(contents) + 1))
    w = np.flatnonzero(np.arange(len(h)) + SIZE <= first[1:][row])
    return row[w], w - first[row[w]], _fold_words(h, w, np.full(len(w), SIZE), np.zeros(len(w), np.uint64))


def by_print(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, s, w = prints(contents)
    return at, s, w, np.argsort(w, kind="stable")


class Words:
    """passages.Parser over stretches as recompress() gives them."""

    size = SIZE
    prints = staticmethod(prints)
    sorted = staticmethod(by_print)

    def __init__(self, looked_into: Broadcast):
        self.looked_into = looked_into

    def parse(self, rows: pa.RecordBatch) -> Iterator[Parsed]:
        yield _parse(rows, self.looked_into.value)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # bytes split at \x20 and \x09-\x0D
            cut = covered(spans.as_py(), SIZE, len(words))
            out, k = [], 0
            for a, e in cut:
                out += words[k:a]
                k = e
            out = out + words[k:] if cut else words
            rows.append((len(words), len(words) - len(out), hashlib.sha256(b" ".join(out)).hexdigest(), [{"start": a, "stop": e} for a, e in cut]))
        n, gone, sha, cut = zip(*rows, strict=True) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["id", "n_words", "n_removed", "kept_sha256", "removed"])


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and removed (word stretches [start, stop)), one row for each of docs.

    A word goes if a window of 35 words of its text that covers it has an equal one starting anywhere else. Null has no
    words; shorter texts lose nothing. Rows with a null id take no part and lose nothing. Rows that repeat an id are equal
    windows elsewhere for each other, and each loses what any of them loses.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    common.bound_batches(docs.sparkSession)
    tries = (recompress(stretches(x.where("doc is not null and text is not null")), seed) for seed in itertools.count())
    state = next(s for s in tries if s is not None)
    seen, entries, looked_into = long_symbols(state)
    known = seen.join(entries.where("n > 1"), "name").select("doc", "a", "b")
    spans = repeats(state, Words(looked_into), first_stays=False, known=known, spent=True)
    common.discard(seen, entries)
    return with_spans(x, spans, _kept, "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")


def op3_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_words(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def sql() -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {common.blank_words_sql("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(w[i + 1:i + 35], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM d)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM s JOIN (SELECT x FROM s GROUP BY x HAVING count(*) > 1) USING (x)),
u AS (SELECT doc_id, w[k + 1] AS t, k FROM (SELECT doc_id, w, unnest(range(len(w))) AS k FROM d) ANTI JOIN g USING (doc_id, k)),
j AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY k) AS t FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(j.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.t, '')) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
