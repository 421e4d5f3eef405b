"""Repeated passages of a fixed length, without comparing windows one by one.

A parser cuts each document into phrases so that (1) each window of the wanted length belongs to exactly one phrase,
(2) equal windows belong to phrases with equal cores, at equal offsets. A phrase is the stretch [a, b + size): its
windows start at a..b. Two keys name it: g, its core, and c, its whole content with the core's offset.

1. Cores that occur once can't hold a repeated window; they are counted and a filter of the others is made.
2. Phrases of repeated cores are counted by (g, c): the dictionary. All windows of a phrase that occurs again are
   repeated, so only the first occurrence of each dictionary entry needs a closer look, and that only if its core has
   other entries: its family.
3. Members of a family travel with their content. Those of families of over FAMILY entries are cut finer first: into
   stretches of at most `width` windows, by the window's offset from its core; all windows of a stretch share all but
   width - 1 of their units, and that is the stretch's core. Of stretches with equal content the first counts again.
4. A family of at most FAMILY entries, fine ones included, comes to one row, where its windows are sorted. Those that
   are larger still, whose size has no bound, give the fingerprints of their windows, which are counted in turn.

All grouping is by hash aggregation, so a passage that a third of all documents share costs a row for each occurrence
and no pairs. Filters are Bloom filters of bounded size: what passes by chance is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .common import Batches


@dataclass
class Phrases:
    """Of some texts: row, first and last window start (in the text), core key, content key."""

    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    g: np.ndarray
    c: np.ndarray


@dataclass
class Stretches(Phrases):
    """Parts of phrases; of: the phrase."""

    of: np.ndarray


#: Phrases of some texts; indices of phrases -> their stretches; first and last starts with rows -> contents.
Parsed = tuple[Phrases, Callable[[np.ndarray], Stretches], Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]]


class Parser(Protocol):
    """size: units of a window; parse: in parts of bounded size, whatever the length of a text; prints: contents -> (index,
    window's place in it, fingerprint) of all their windows; sorted: the same with classes of equal windows for fingerprints,
    then the order of the windows by class, those of a class as they came."""

    size: int

    def parse(self, rows: pa.RecordBatch) -> Iterator[Parsed]: ...

    def prints(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...

    def sorted(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]: ...


def finer(k: np.ndarray, p: Phrases, at: np.ndarray, size: int, width: int, fold_units: Callable) -> Stretches:
    """Stretches of phrases k, whose core is at `at` of the units that fold_units(start, size, seed, row) reads."""
    low, high = (at[k] - p.b[k]) // width, (at[k] - p.a[k]) // width
    count = high - low + 1
    of = np.repeat(k, count)
    j = np.repeat(low, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    t = at[of] - width * j  # the last start
    a, b = np.maximum(p.a[of], t - width + 1), np.minimum(p.b[of], t)
    g = fold_units(t, np.full(len(of), size - width + 1), common.mix64((j + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), p.row[of])
    c = fold_units(a, b - a + size, common.mix64((t - a).astype(np.uint64) + np.uint64(1 << 32)), p.row[of])
    return Stretches(p.row[of], a, b, g, c, of)


#: Entries of a family that are compared in one row; each has the content of a phrase, under two windows long.
FAMILY = 128
#: Window starts whose spans are merged at once; what a group collects stays under that.
BLOCK = 1 << 16


def place(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    return common.mix64(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)).view(np.int64)


def fold(parts: Iterator[tuple[np.ndarray | None, np.ndarray]], h: np.ndarray) -> np.ndarray:
    """h with further values folded in, for all or the indexed entries."""
    for at, v in parts:
        if at is None:
            h = common.mix64(h * np.uint64(0xD6E8FEB86659FD93) + v)
        else:
            h[at] = common.mix64(h[at] * np.uint64(0xD6E8FEB86659FD93) + v)
    return h


def _parsed(batches: Iterator[pa.RecordBatch], parser: Parser) -> Iterator[tuple]:
    for b in batches:
        text, doc = b.column("text"), b.column("doc").to_numpy(zero_copy_only=False)
        for i, j in tokens.pieces(text):
            for p, finer_of, contents in parser.parse(b.slice(i, j - i)):
                if len(p.row):
                    yield doc[i:j][p.row], p, finer_of, contents


def merge_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) sorted by row and a, with those of a row made one whose windows overlap or touch."""
    if not len(row):
        return row, a, b
    apart = np.int64(1 << 40)
    reach = np.maximum.accumulate(b + row * apart)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] + row[1:] * apart > reach[:-1] + size)
    first = np.flatnonzero(new)
    return row[first], a[first], np.maximum.reduceat(b, first)


def _family(parser: Parser, first_stays: bool) -> Batches:
    """Rows of members (doc, a, content) of a core -> (doc, a, b): merged starts of their repeated windows.

    Equal windows have equal cores, so windows of several cores are sorted together and never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(batch.column("members")):
                m = batch.column("members").slice(i, j - i).flatten()
                doc, a = (m.field(k).to_numpy(zero_copy_only=False) for k in ("doc", "a"))
                corpus = np.lexsort((a, doc))
                doc, a = doc[corpus], a[corpus]
                at, s, w, o = parser.sorted(m.field("content").take(pa.array(corpus)).to_pylist())
                if not len(at):
                    continue
                same = w[o][1:] == w[o][:-1]
                again = np.concatenate([[False], same])
                if not first_stays:
                    again[:-1] |= same
                hit = np.sort(o[again])  # by member, then by place
                row, x, y = merge_spans(at[hit], s[hit], s[hit], parser.size)
                yield pa.RecordBatch.from_pydict({"doc": doc[row], "a": a[row] + x, "b": a[row] + y})

    def runs(members: pa.ListArray, most: int = 4 * FAMILY) -> Iterator[tuple[int, int]]:
        ends = np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield i, j
            i = j

    return run


def repeats(docs: DataFrame, parser: Parser, first_stays: bool, known: DataFrame | None = None, spent: bool = False) -> DataFrame:
    """doc, spans: for each document with repeated windows sorted stretches [a, b] of starts whose windows cover what they do.

    docs: doc (long, not null), text, and what else the parser reads; known: doc, a, b of repeats that are known already; spent: docs is a scratch table
    that nothing needs afterwards.
    first_stays: a window is repeated if an equal one has a smaller (doc, start), else
    if there is an equal one anywhere else.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p, _, _ in _parsed(batches, parser):
            yield pa.RecordBatch.from_pydict({"g": p.g.view(np.int64)})

    again = common.materialize(docs.mapInArrow(common.frugal(cores), "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "rep-cores")
    some = spark.sparkContext.broadcast(common.build_bloom(again, common.bits_for(again.count())))
    common.discard(again)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, p, _, _ in _parsed(batches, parser):
            k = common.bloom_has(some.value, p.g)
            yield pa.RecordBatch.from_pydict({"g": p.g[k].view(np.int64), "c": p.c[k].view(np.int64), "doc": doc[k], "a": p.a[k].astype(np.int64), "b": p.b[k].astype(np.int64)})

    parse = common.materialize(docs.mapInArrow(common.frugal(phrases), "g long, c long, doc long, a long, b long"), "rep-parse")
    entry = F.min(F.struct("doc", "a")).alias("first")
    dictionary = common.materialize(parse.groupBy("g", "c").agg(entry, F.count(F.lit(1)).alias("n")).select("g", "c", F.col("first.doc").alias("fd"), F.col("first.a").alias("fa"), "n"), "rep-dictionary")
    common.release(spark)
    several = common.materialize(dictionary.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "rep-families")
    closer = common.materialize(dictionary.join(common.sized_broadcast(several), "g").select("fd", "fa", (F.col("k") > FAMILY).alias("large")), "rep-closer")

    def place_of(b: pa.RecordBatch) -> np.ndarray:
        return place(b.column("fd").to_numpy(), b.column("fa").to_numpy())

    def look(which: str) -> Broadcast:
        keys = closer.where(which).select("fd", "fa")
        return spark.sparkContext.broadcast(common.build_bloom(keys, common.bits_for(keys.count()), key=place_of))

    small, large = look("not large"), look("large")
    firsts = closer.select("fd").distinct()
    wanted = spark.sparkContext.broadcast(common.build_bloom(firsts, common.bits_for(firsts.count())))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some_docs = (b.filter(pa.array(common.bloom_has(wanted.value, b.column("doc").to_numpy(zero_copy_only=False)))) for b in batches)
        for doc, p, finer, contents in _parsed(some_docs, parser):
            known, at = common.bloom_has(some.value, p.g), place(doc, p.a)
            k = np.flatnonzero(known & common.bloom_has(small.value, at))
            yield row_batch(p, doc, k, contents(p.a[k], p.b[k], p.row[k]))
            k = np.flatnonzero(known & common.bloom_has(large.value, at))
            for i in range(0, len(k), 5_000):
                f = finer(k[i : i + 5_000])
                yield row_batch(f, doc[f.of], slice(None), contents(f.a, f.b, f.row))

    def row_batch(p: Phrases, doc: np.ndarray, k: np.ndarray | slice, contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": p.g[k].view(np.int64), "c": p.c[k].view(np.int64), "doc": doc[k], "a": p.a[k].astype(np.int64), "b": p.b[k].astype(np.int64), "content": pa.array(contents, pa.binary())})

    seen = common.materialize(docs.mapInArrow(common.frugal(members), "g long, c long, doc long, a long, b long, content binary"), "rep-members")
    if spent:
        common.discard(docs)
    # Stretches that occur again are repeated whole; of each the first meets those of its family.
    own = seen.groupBy("g", "c").agg(F.min(F.struct("doc", "a", "content")).alias("m"), F.count(F.lit(1)).alias("n"))
    own = common.materialize(own.select("g", "c", F.col("m.doc").alias("fd"), F.col("m.a").alias("fa"), F.col("m.content").alias("content"), "n"), "rep-own")
    common.release(spark)
    sizes = common.materialize(own.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "rep-sizes")
    kin = own.join(common.sized_broadcast(sizes), "g").select("g", F.struct(F.col("fd").alias("doc"), F.col("fa").alias("a"), "content").alias("m"), "k")
    found = kin.where(F.col("k") <= FAMILY).groupBy("g").agg(F.collect_list("m").alias("members")).select("members").mapInArrow(common.frugal(_family(parser, first_stays)), "doc long, a long, b long")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2_000):
                part = b.slice(i, 2_000)
                g, doc, a = (part.column(n).to_numpy() for n in ("g", "doc", "a"))
                at, s, w = parser.prints(part.column("content").to_pylist())
                yield pa.RecordBatch.from_pydict({"g": g[at], "c": w.view(np.int64), "doc": doc[at], "a": a[at] + s})

    windows = common.materialize(kin.where(F.col("k") > FAMILY).select("g", "m.*").mapInArrow(common.frugal(expand), "g long, c long, doc long, a long"), "rep-windows")
    twice = common.materialize(windows.groupBy("g", "c").agg(entry, F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "c", F.col("first.doc").alias("fd"), F.col("first.a").alias("fa"), "n"), "rep-twice")
    for occurrences, entries in ((parse, dictionary), (seen, own), (windows.withColumn("b", F.col("a")), twice)):
        # Both sides are tables, so that Spark can split the partition of a passage that very many documents share.
        x = occurrences.select("g", "c", "doc", "a", "b").join(entries.where("n > 1").select("g", "c", "fd", "fa"), ["g", "c"])
        if first_stays:
            x = x.where("doc <> fd or a <> fa")
        found = found.union(x.select("doc", "a", "b"))

    if known is not None:
        found = found.union(known)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            values = spans.flatten()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
            row, x, y = merge_spans(row, *(values.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b")), parser.size)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "spans": pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["a", "b"]))})

    some_of = found.groupBy("doc", F.floor(F.col("a") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    runs = some_of.select("doc", "spans").mapInArrow(common.frugal(merged), "doc long, spans array<struct<a:bigint,b:bigint>>")
    spans = common.materialize(runs.groupBy("doc").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")), "rep-spans")
    common.discard(parse, dictionary, several, closer, seen, own, sizes, windows, twice)
    common.release(spark)
    return spans


def with_spans(docs: DataFrame, spans: DataFrame, kept: Batches, schema: str) -> DataFrame:
    """kept, which maps rows (id, text, spans) to rows of schema, over docs (doc, text).

    A filter of the ids tells texts that surely have no spans. These pass straight; only the others travel to the join.
    """
    filled = docs.sparkSession.sparkContext.broadcast(common.build_bloom(spans.select("doc"), common.bits_for(spans.count())))

    def parted(wanted: bool) -> Batches:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc = b.column("doc")
                maybe = doc.is_valid().to_numpy(zero_copy_only=False)
                maybe[maybe] = common.bloom_has(filled.value, doc.drop_null().to_numpy(zero_copy_only=False))
                yield b.filter(pa.array(maybe == wanted))

        return run

    def straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parted(False)(batches):
            yield from kept(iter([pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), pa.nulls(b.num_rows)], ["id", "text", "spans"])]))

    x = docs.select("doc", "text")
    joined = x.mapInArrow(common.frugal(parted(True)), "doc long, text string").join(spans.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left")
    return joined.select(F.col("doc").alias("id"), "text", "spans").mapInArrow(common.frugal(kept), schema).union(x.mapInArrow(common.frugal(straight), schema))


def covered(spans: list[dict] | None, size: int, n: int) -> list[tuple[int, int]]:
    """Maximal stretches of units that the windows starting in spans cover, within n units."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, e = s["a"], min(n, s["b"] + size)
        if a >= e:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out
