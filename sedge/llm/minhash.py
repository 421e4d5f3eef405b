"""MinHash near-dedup with HyperMinHash sketches.

Sketch: a shingle's hash picks a register; a register keeps of its least second hash the number of leading zeros and
MANTISSA bits after them, 16 bits in all. Empty registers of short texts borrow from filled ones in an order that is the
same for all texts. BANDS bands of ROWS compressed registers give candidates. A candidate's Jaccard estimate, corrected
for the chance collisions of registers of sets of such sizes, must come within six standard deviations of the threshold; then
full sets decide.

Texts with equal shingle sets are one class with one representative, so copies never meet in a band. Where more than
CROWD classes share a bucket, its members meet in their rarest shingles instead (_company), which tells apart copies that
were edited too much from those that were not. A bucket of at most SMALL classes gives its pairs; a larger one is worked
in rounds: some centres (first the least edited, then ever more, picked by hash) are held against the members of other
components that they can be linked with, judged by where the bucket's shingle stands in both, and leave the bucket. A
bucket is done when its members are one component or all have been centres. So each link between different components is
tried, and a large group of near copies costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SHINGLE, BANDS, ROWS, MANTISSA, SMALL, CROWD, GROW = 5, 24, 4, 10, 16, 4, 64
REGISTERS = BANDS * ROWS


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each text, sorted; of fewer words, of the whole sequence."""
    data, at = tokens.joined(texts, lower=True)
    start, end = tokens.words(data)
    h = tokens.word_hashes(data, start, end)
    row = np.searchsorted(at, start, "right") - 1
    x = tokens.rolled(h, k)
    own = row[: len(x)] == row[k - 1 :] if len(x) else np.zeros(0, bool)
    rows, hashes = [row[: len(x)][own]], [x[own]]
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    for n in range(1, k):
        some = np.flatnonzero(count == n)
        if len(some):
            y = np.full(len(some), n, np.uint64)
            for i in range(n):
                y = common.mix64(y * np.uint64(0xD6E8FEB86659FD93) + h[first[some] + i])
            rows.append(some)
            hashes.append(y)
    r, x = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new], x[new]


def _compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and MANTISSA bits after the leading one."""
    least = np.maximum(least, np.uint64(1 << 12))
    bits = np.frexp((least >> np.uint64(11)).astype(np.float64))[1] + 11
    zeros = (64 - bits).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


_PROBE = np.stack([common.mix64(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1000 * t)) % np.uint64(REGISTERS) for t in range(1, 49)]).astype(np.int64)


def registers(n_rows: int, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """n_rows x REGISTERS; rows without shingles are 0."""
    out = np.zeros((n_rows, REGISTERS), np.uint16)
    if not len(x):
        return out
    # x is sorted within a row, so the registers, its leading part, are sorted too.
    reg = ((x >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    slot = row * REGISTERS + reg
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    out.ravel()[slot[first]] = _compress(np.minimum.reduceat(common.mix64(x ^ np.uint64(0xA5A5A5A5DEADBEEF)), first))
    full = np.zeros(out.shape, bool)
    full.ravel()[slot[first]] = True
    base, was = out.copy(), full.copy()
    for probe in _PROBE:
        if full.all():
            break
        take = ~full & was[:, probe]
        out[take] = base[:, probe][take]
        full |= take
    for shift in range(1, REGISTERS):  # the few that are left take the next filled one
        if not (~full[was.any(1)]).any():
            break
        take = ~full & np.roll(was, -shift, 1)
        out[take] = np.roll(base, -shift, 1)[take]
        full |= take
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(regs).view("<u8")
    return common.mix64(packed + common.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely unequal minima of sets of n and m shingles look alike in a register.

    A register's share of a set has about n / REGISTERS hashes, whose minimum has the density n e**(-n x). Minima look alike if they
    fall into one cell: of the range of p leading zeros, which has 2**MANTISSA cells of 2**-(p + 1 + MANTISSA) each.
    """
    n, m = (np.maximum(1.0, np.asarray(x, np.float64) / REGISTERS)[..., None] for x in (n, m))
    low = 0.5 ** np.arange(1, 53)
    both = n * m / (n + m) * (np.exp(-(n + m) * low) - np.exp(-(n + m) * 2 * low))
    return (both * low).sum(-1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows of sets of n and m shingles, less what chance makes look alike."""
    by_chance = chance(n, m)
    return np.maximum(0, ((a == b).mean(1) - by_chance) / (1 - by_chance))


# ---------------------------------------------------------------- over tables


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in tokens.pieces(b.column("text")):
            row, x = shingles(b.column("text").slice(i, j - i))
            n = np.bincount(row, minlength=j - i)
            regs = registers(j - i, row, x)
            d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            if len(x):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                d1[row[first]] = np.add.reduceat(common.mix64(x + np.uint64(1)), first)
                d2[row[first]] = np.bitwise_xor.reduceat(common.mix64(x + np.uint64(2)), first)
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc").slice(i, j - i), "n": n.astype(np.int64), "d1": d1.view(np.int64), "d2": d2.view(np.int64), "regs": pa.array([r.tobytes() for r in regs], pa.binary())})


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        keys = band_keys(np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS))
        yield pa.RecordBatch.from_pydict({"rep": np.repeat(b.column("rep").to_numpy(), BANDS), "key": keys.ravel().view(np.int64)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in tokens.pieces(b.column("text")):
            row, x = shingles(b.column("text").slice(i, j - i))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep").slice(i, j - i), "items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.view(np.int64)))})


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node that can be reached.

    Each round takes the least label of the neighbours, then that label's own label; rounds grow with the logarithm of
    the longest path. All tables are written, so that joins have plain exchanges that Spark can split at hubs.
    """
    both = common.materialize(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "cc-links")
    labels = common.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        step = common.materialize(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")), "cc-step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = common.materialize(step.join(jump, "new").select("node", F.col("label").alias("was"), F.least("new", "up").alias("label")), "cc-jump")
        moved = after.where("label <> was").limit(1).count()
        common.discard(labels)
        common.discard(step)
        labels = after
        if not moved:
            return after.select("node", "label")


def _verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b)."""
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    @F.pandas_udf("double")
    def similar(a, b, n, m):  # noqa: ANN001, ANN202
        import pandas as pd

        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(estimate(x, y, n.to_numpy(), m.to_numpy()))

    regs = reps.select("rep", "regs", "n")
    near = pairs.join(regs.toDF("b", "rb", "nb"), "b").join(regs.toDF("a", "ra", "na"), "a").where(similar("ra", "rb", "na", "nb") >= least).select("a", "b")
    near = common.materialize(near, "lsh-near")
    # The second side's set travels to the first, which may be a centre of very many pairs.
    full = near.join(sets.toDF("b", "ib"), "b").join(sets.toDF("a", "ia"), "a")
    inter = F.size(F.array_intersect("ia", "ib"))
    return full.where(100 * inter >= percent * (F.size("ia") + F.size("ib") - inter)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and n_shingles, component_id, kept (columns of these names are replaced).

    Words are runs of non-blank characters with A-Z lower-cased; a text's set is that of its 5-word shingles, of the
    whole sequence if shorter. Texts are linked if 100 * intersection >= percent * union, and a component is what links
    connect; its least id names it and stays. Null and wordless texts have no set and are kept alone. Ids name documents:
    rows that repeat an id with equal text share one fate; a null id is alone and kept. An empty table gives no rows.
    """
    new = ["n_shingles", "component_id", "kept"]
    rest = [c for c in docs.columns if c not in new]
    groups = duplicate_groups(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), percent)
    groups = groups.select(F.col("doc").alias("_doc"), *new).dropDuplicates(["_doc"])
    return docs.select(*rest).join(groups, F.col(id_col).eqNullSafe(F.col("_doc"))).select(*rest, *new)


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, all columns; texts are not shuffled to find them."""
    groups = duplicate_groups(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), percent)
    gone = common.materialize(groups.where("not kept").select("doc").distinct(), "lsh-gone")
    return common.without(docs, gone, id_col)


def duplicate_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc, n_shingles, component_id, kept for docs (doc, text)."""
    common.bound_batches(docs.sparkSession)
    sig = common.materialize(docs.mapInArrow(common.frugal(_sketch), "doc long, n long, d1 long, d2 long, regs binary"), "lsh-sketches")
    reps = sig.where("n > 0 and doc is not null").groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep"), F.first("regs").alias("regs"))
    reps = common.materialize(reps, "lsh-classes")
    bands = reps.select("rep", "regs").mapInArrow(common.frugal(_bands), "rep long, key long")
    shared = common.materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lsh-buckets")
    live = common.materialize(bands.join(common.sized_broadcast(shared), "key"), "lsh-members")
    ids = live.select("rep").distinct()
    texts = docs.select(F.col("doc").alias("rep"), "text").join(common.sized_broadcast(ids), "rep", "left_semi")
    sets = common.materialize(texts.mapInArrow(common.frugal(_sets), "rep long, items array<bigint>").dropDuplicates(["rep"]), "lsh-sets")

    live = _company(live, sets, percent)

    # Pairs of small buckets, each with at most SMALL members.
    small = live.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "s", "k"))).alias("m"))
    pairs = small.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
    pairs = pairs.where(_possible(F.col("x.s"), F.col("x.k"), F.col("y.s"), F.col("y.k"), percent)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    big = common.materialize(live.where(F.col("size") > SMALL), "lsh-big")
    left = big.count()
    first = common.materialize(big.groupBy("key").agg(F.min(F.struct("own", "rep")).alias("m")).select("key", F.col("m.rep").alias("rep")), "lsh-centres")
    pairs = pairs.union(_against(first, big.withColumn("label", F.col("rep")), percent))
    links = common.materialize(_verify(common.materialize(pairs.distinct(), "lsh-pairs"), reps, sets, percent), "lsh-links")
    labels = components(links).toDF("rep", "label")
    tried, t = first, 0
    while left:
        t += 1
        here = big.join(common.sized_broadcast(tried), ["key", "rep"], "left_anti").join(labels, "rep", "left")
        here = common.materialize(here.withColumn("label", F.coalesce("label", "rep")).select(*_MEMBER, "label"), "lsh-here")
        # A bucket whose tried members are gone is done once the others are one component.
        open_ = common.materialize(here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "lsh-open")
        here = common.materialize(here.join(common.sized_broadcast(open_), "key", "left_semi"), "lsh-left")
        big, left = here.drop("label"), here.count()
        if not left:
            break
        tried = common.materialize(here.where(F.pmod(F.xxhash64("rep", "key", F.lit(t)), F.col("size")) < GROW**t).select("key", "rep"), "lsh-centres")
        pairs = common.materialize(_against(tried, here, percent).distinct(), "lsh-pairs")
        more = common.materialize(_verify(pairs, reps, sets, percent), "lsh-links")
        if more.limit(1).count():
            links = common.materialize(links.union(more), "lsh-links")
            labels = components(links).toDF("rep", "label")
    named = reps.select("d1", "d2", "n", "rep").join(labels, "rep", "left").select("d1", "d2", "n", F.coalesce("label", "rep").alias("component_id"))
    named = common.materialize(named, "lsh-named")
    some = sig.where("n > 0 and doc is not null").select("doc", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select("doc", F.col("n").alias("n_shingles"), "component_id")
    none = sig.where("n = 0 or doc is null").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return some.union(none).withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))


_MEMBER = ("key", "rep", "size", "s", "own", "k")


def _possible(sa: Column, ka: Column, sb: Column, kb: Column, percent: int) -> Column:
    """Two sets of sizes sa and sb can be linked if the first item that they share, rarest first, stands at ka and kb: all
    the items before are not common."""
    most = 1 + F.least(sa - ka, sb - kb)
    return 100 * most >= percent * (sa + sb - most)


def _company(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The buckets to work on: key, rep, size (of the bucket), s (size of the set), own (items that only this set has), k
    (where the key stands among the set's items, rarest first).

    Buckets of at most CROWD members stay as they are, with own 0 and k 1. The members of larger ones can share most of
    their text without being linked, as in a large group of copies that were edited more and more. Among all of these the
    items are counted exactly, and they meet in their rarest items instead: of s items a linked partner shares all but
    100 - percent of a hundred, so both have a common item among their s - ceil(percent * s / 100) + 1 rarest. Items of
    one text alone come first, so a text with many of these has few keys or none.
    """
    crowded = live.where(F.col("size") > CROWD)
    members = common.sized_broadcast(common.materialize(crowded.select("rep").distinct(), "lsh-crowd"))
    items = common.materialize(sets.join(members, "rep", "left_semi"), "lsh-crowd-sets")
    each = items.select("rep", F.explode("items").alias("item"))
    count = common.materialize(each.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")), "lsh-items")
    own = common.materialize(count.where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own")), "lsh-own")
    known = items.select("rep", "items", F.size("items").cast("long").alias("s")).join(common.sized_broadcast(own), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # With no item in common among the own ones, the first common one stands after them.
    known = common.materialize(known.where(_possible(F.col("s"), F.col("own") + 1, F.col("s") - F.col("own"), F.lit(1), percent)), "lsh-company")
    shared = known.select("rep", F.explode("items").alias("item")).join(count.where("n > 1").select("item", "n"), "item")
    rare = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("r"))
    rare = rare.join(known.select("rep", "s", "own"), "rep")
    prefix = F.slice("r", F.lit(1), F.greatest(F.col("s") - F.ceil(percent * F.col("s") / 100) + 1 - F.col("own"), F.lit(0)).cast("int"))
    rows = rare.select("rep", "s", "own", F.posexplode(prefix).alias("k", "x")).select("rep", "s", "own", (F.col("own") + F.col("k") + 1).alias("k"), F.col("x.item").alias("key"))
    rows = common.materialize(rows, "lsh-prefixes")
    again = common.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lsh-buckets")
    rows = rows.join(common.sized_broadcast(again), "key")
    few = live.where(F.col("size") <= CROWD).join(sets.select("rep", F.size("items").cast("long").alias("s")), "rep").withColumns({"own": F.lit(0).cast("long"), "k": F.lit(1).cast("long")})
    return common.materialize(few.select(*_MEMBER).union(rows.select(*_MEMBER)), "lsh-members")


def _against(centres: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each centre with the members of its bucket that are of other components and can be linked by it.

    a is the less edited one, so that only a is hot.
    """
    c = centres.join(members, ["key", "rep"]).select("key", *(F.col(x).alias(f"c_{x}") for x in ("rep", "s", "own", "k", "label")))
    here = (F.col("label") != F.col("c_label")) & _possible(F.col("s"), F.col("k"), F.col("c_s"), F.col("c_k"), percent)
    m = members.join(common.sized_broadcast(common.materialize(c, "lsh-against")).withColumnRenamed("key", "c_key"), (F.col("key") == F.col("c_key")) & here)
    first = F.struct("own", "rep") < F.struct(F.col("c_own").alias("own"), F.col("c_rep").alias("rep"))
    return m.select(F.when(first, F.col("rep")).otherwise(F.col("c_rep")).alias("a"), F.when(first, F.col("c_rep")).otherwise(F.col("rep")).alias("b"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return duplicate_groups(docs, 85).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


def sql() -> str:
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {common.blank_words_sql(common.lower_sql('text'))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.doc_id WHERE r.r < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS m FROM r GROUP BY doc_id) c USING (doc_id)
"""
