"""Suffix-array dedup by prefix-free parsing.

Triggers: the 32 bytes with the least rolling hash of each 100-byte window (the leftmost of equals), as a window without
any trigger could not be found again. Phrases run from trigger to trigger and overlap by 99 bytes, so each window lies in
one phrase whole, and what follows a trigger is read alike wherever it stands. Distinct phrases are the dictionary, their
occurrences the parse.

The dictionary's suffix array (suffix_array) orders the suffixes of its entries by their first 100 bytes, by prefix doubling
on the bytes themselves. It is built in parts: equal windows have the same trigger, so entries of one trigger are sorted
together, as one row or a few beside others. As phrases overlap by 99 bytes, a suffix of the parse never needs its second
phrase: its order is that of its first phrase, then that of the corpus, and this order is the groups of the parse by
dictionary entry with their first places. Both combine into corpus order (doc_id, start): windows that have 100 bytes in
common with the one before them in the suffix array are an interval, ties stand as in the corpus, and all but the first go;
all occurrences of an entry but its first go whole. Only entries of a trigger that stands in very many (passages.FAMILY),
even when cut finer, are not sorted in a row: Spark groups the fingerprints of their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .passages import Parsed, Phrases, covered, finer, fold, repeats, with_spans

SIZE, GRAM, WIDTH = 100, 32, 17
_PLACES = SIZE - GRAM + 1
#: A place within the bytes parsed at once, which are fewer.
_LOW = np.uint64((1 << 24) - 1)
#: A longer text is parsed in stretches of so many starts; phrases then end there too, which changes no result.
STRETCH = 1 << 16
_Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _units(texts: pa.Array) -> Iterator[_Units]:
    """Stretches of the texts, some at a time: their bytes; of each its row, its offset in the text, its place in the bytes
    (and the end)."""
    parts, row, off, total = [], [], [], 0

    def made() -> _Units:
        data = np.frombuffer(b"".join(parts) + b"\0" * 200, np.uint8)
        return data, np.array(row, np.int64), np.array(off, np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    for i, t in enumerate(texts):
        raw = t.as_buffer() if t.is_valid else b""
        for k in range(0, len(raw) - SIZE + 1, STRETCH):
            if parts and (row[-1] == i or total + min(len(raw) - k, STRETCH) > STRETCH):
                yield made()
                parts, row, off, total = [], [], [], 0
            parts.append(memoryview(raw)[k : k + STRETCH + SIZE - 1])
            row.append(i)
            off.append(k)
            total += len(parts[-1])
    if parts:
        yield made()


def _hash(at8: np.ndarray, start: np.ndarray, size: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """h with `size` bytes from each start folded in."""
    size = np.broadcast_to(np.asarray(size), start.shape)

    def parts() -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        for k in range(0, int(size.max()) if len(size) else 0, 8):
            if (size >= k + 8).all():
                yield None, at8[start + k]
            else:
                i = np.flatnonzero(size > k)
                yield i, at8[start[i] + k] & tokens._MASK[np.minimum(size[i] - k, 8)]

    return fold(parts(), h)


#: Powers of an odd base and of its inverse modulo 2**64, as many as bytes are parsed at once.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b % (1 << 64), np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial rolling hash modulo 2**64 of the GRAM bytes from each of the first n places on, by running sums."""
    up, down = _powers(n + GRAM)
    total = np.zeros(n + GRAM + 1, np.uint64)
    np.cumsum((data[: n + GRAM] + np.uint64(1)) * up[: n + GRAM], out=total[1:])
    return (total[GRAM : n + GRAM] - total[:n]) * down[:n]


def parse(rows: pa.RecordBatch) -> Iterator[Parsed]:
    for units in _units(rows.column("text")):
        yield _phrases(*units)


def _phrases(data: np.ndarray, row: np.ndarray, off: np.ndarray, at: np.ndarray) -> Parsed:
    n = int(at[-1])
    at8 = tokens.u8_at(data)
    x = common.mix64(_rolling(data, n))
    # The trigger of each window: least upper 40 bits, then leftmost.
    m = np.concatenate([(x & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW), np.full(SIZE, ~np.uint64(0))])
    width = 1
    while width * 2 <= _PLACES:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (_PLACES - width)], m[_PLACES - width :])[:n]
    unit = np.repeat(np.arange(len(row)), np.diff(at))
    s = np.flatnonzero(np.arange(n) + SIZE <= at[1:][unit])
    t = (m[s] & _LOW).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    a, b, t = s[first], s[np.concatenate([first[1:], [len(s)]]) - 1], t[first]
    own = unit[a]
    shift = off[own] - at[own]
    c = _hash(at8, a, b - a + SIZE, common.mix64((t - a).astype(np.uint64)))

    # Each row has one stretch here, so a place in a text is one in the bytes less a shift by row.
    back = np.zeros(int(row.max()) + 1, np.int64)
    back[row] = at[:-1] - off

    def read(start: np.ndarray, size: np.ndarray, seed: np.ndarray, of: np.ndarray) -> np.ndarray:
        return _hash(at8, start + back[of], size, seed)

    def contents(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> list[bytes]:
        raw = data.tobytes()  # not a view: pyarrow never lets go of a view that it made a binary value of, nor of all its bytes
        return [raw[i:j] for i, j in zip((a + back[of]).tolist(), (b + SIZE + back[of]).tolist(), strict=True)]

    phrases = Phrases(row[own], a + shift, b + shift, x[t], c)
    return phrases, lambda k: finer(k, phrases, t + shift, SIZE, WIDTH, read), contents


def _windows(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content, place in it and place in the joined bytes of each window of SIZE bytes; the bytes."""
    size = np.array([len(c) for c in contents], np.int64)
    count = np.maximum(size - SIZE + 1, 0)
    own = np.repeat(np.arange(len(contents)), count)
    s = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return own, s, (np.cumsum(size) - size)[own] + s, np.frombuffer(b"".join(contents) + b"\0" * 8, np.uint8)


def prints(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, s, at, data = _windows(contents)
    return own, s, _hash(tokens.u8_at(data), at, SIZE, np.zeros(len(own), np.uint64))


def suffix_array(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the places `at` (all `size` bytes before the end of data less its 8 bytes of padding) by their first
    `size` bytes, 8 or more: the order of the places, equal ones as they come, and their ranks, equal for equal bytes.

    Ranks by 8 bytes are doubled to 16, 32 and so on; the last step overlaps. No hash is involved.
    """
    n = len(data) - 8

    def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), np.uint64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(new)
        return order, rank

    width, (_, r) = 8, ranks(tokens.u8_at(data)[:n].byteswap())
    while width * 2 <= size:
        after = np.zeros(n, np.uint64)
        after[: n - width] = r[width:]
        r = ranks(r << np.uint64(32) | after)[1]
        width *= 2
    if width < size:
        return ranks(r[at] << np.uint64(32) | r[at + size - width])
    return ranks(r[at])


def by_suffix(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own, s, at, data = _windows(contents)
    order, rank = suffix_array(data, at, SIZE)
    return own, s, rank, order


class Bytes:
    """passages.Parser over bytes."""

    size = SIZE
    parse = staticmethod(parse)
    prints = staticmethod(prints)
    sorted = staticmethod(by_suffix)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            cut = covered(spans.as_py(), SIZE, len(raw))
            out, k = [], 0
            for a, e in cut:
                out.append(raw[k:a])
                k = e
            out.append(raw[k:])
            kept = b"".join(out)
            rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": e} for a, e in cut]))
        n, gone, spans, sha, cut = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte stretches [start, stop)), one row for each of docs.

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller id, or earlier in the same text.
    Null is empty; texts under 100 bytes lose nothing. Rows with a null id take no part and lose nothing. Rows that repeat
    an id stand at the same place: none is an earlier copy of another, and each loses what any of them loses.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spans = repeats(x.where("doc is not null and text is not null"), Bytes(), first_stays=True)
    return with_spans(x, spans, _kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, b, h[2 * b + 1:2 * b + 1198] AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(CAST(length(h) // 2 - 99 AS BIGINT), 0), 500)) AS b FROM d)),
s AS MATERIALIZED (SELECT doc_id, b + j AS i, md5_number(h[2 * j + 1:2 * j + 200]) AS x FROM (SELECT doc_id, b, h, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS j FROM b)),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
c AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
f AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR p + 100 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
q AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM f GROUP BY doc_id, run),
o AS (SELECT doc_id, count(*) AS n, sum(e - a) AS z, list(struct_pack(a := a, e := e) ORDER BY a) AS l FROM q GROUP BY doc_id),
k AS (SELECT doc_id, h, n, z, [0] || list_transform(l, lambda x: x.e) AS starts, list_transform(l, lambda x: x.a) || [CAST(length(h) // 2 AS BIGINT)] AS ends FROM d JOIN o USING (doc_id)),
t AS (SELECT doc_id, n, z, array_to_string(list_transform(range(len(starts)), lambda j: h[2 * starts[j + 1] + 1:2 * ends[j + 1]]), '') AS h FROM k)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.z, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
