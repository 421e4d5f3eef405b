"""Benchmark decontamination: prefix-filtered set join, in DataFrame operations only.

A window is `size` consecutive words of a benchmark item (all of a shorter item). Its set is that of its word shingles.
Exact containment asks for every shingle of a window, so the necessary prefix of a window in rarity order is its single
rarest shingle. A first pass over the whole corpus writes where benchmark shingles stand, which gives their rarity; of
these places the second pass joins only those of prefix shingles, and a hit at offset o of the window and position p of
the document can only start at p - o, within the document's length. What is left is verified word for word against the
document.

The sides that are broadcast hold benchmark windows, never corpus rows, and only up to common.BROADCAST_ROWS rows, which
are counted first. Of more shingles than that the first pass is made in blocks, one broadcast each, so that the corpus is
read again for each million of them but its shingles are never shuffled; the other sides are then shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text that is not lower-cased.
MIXED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE, SHINGLE = 13, 3


def words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and non-ASCII characters; none for null."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), MIXED), "")).cast("long")


def _shingles(w: Column, j: int) -> Column:
    """64-bit hashes of j consecutive words by their first position; an empty array for fewer words."""
    n = F.size(w)
    hashed = F.transform(w, lambda x, i: F.xxhash64(F.lit(j), x, *(F.get(w, i + k) for k in range(1, j))))
    return F.when(n >= j, F.slice(hashed, 1, n - (j - 1))).otherwise(F.array().cast("array<bigint>"))


def windows(bench: DataFrame, size: int = SIZE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, window (words joined by one space), len: each distinct window of each item."""
    w = bench.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.lit(size), F.size("w")))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("o")
    return w.select("item_id", "w", "len", at).select("item_id", F.array_join(F.slice("w", F.col("o") + 1, F.col("len")), " ").alias("window"), "len").distinct()


def contamination(docs: DataFrame, bench: DataFrame, size: int = SIZE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and n_words, n_hit, n_items, items_sha256, contaminated (columns of these names are replaced).

    contaminated: at least one word is hit and 20 * n_hit >= n_words. Null and wordless texts have no words and hit
    nothing; wordless items have no window. Repeated ids and rows are each judged on their own text. With no items all
    counts are 0 and items_sha256 is that of the empty string. Item ids are compared and joined as strings; a null item
    id is left out of the list. A text of any length is one array of words; with the windows that may be in it, it fits a task.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rest = [c for c in docs.columns if c not in new]
    # A document is named by 128 bits of its id and text.
    named = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(*named).alias("a"), F.xxhash64(F.lit(1), *reversed(named)).alias("b")).alias("_k")
    of_items = common.materialize(windows(bench, size), "decon-windows")
    n_windows = of_items.count()
    lengths = sorted({min(shingle, r["len"]) for r in of_items.select("len").distinct().collect()})  # at most `size` rows

    distinct = of_items.select("window", "len").distinct()
    parts = []
    for j in lengths:
        short = F.least(F.lit(shingle), F.col("len")) == j
        parts.append(distinct.where(short).withColumn("w", F.split("window", " ")).select("window", "len", "w").select("window", "len", F.posexplode(_shingles(F.col("w"), j)).alias("o", "h")))

    parsed = docs.select(key, words(F.col(text_col)).alias("w"))
    base = docs.select(*rest, key, count_words(F.col(text_col)).alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not lengths:
        return base.select(*rest, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    grams = parts[0]
    for x in parts[1:]:
        grams = grams.unionByName(x)
    grams = common.materialize(grams, "decon-grams")
    n_grams = grams.count()
    # Pass one: where each benchmark shingle stands in the corpus, and how often.
    blocks = -(-n_grams // common.BROADCAST_ROWS)
    every = [parsed.select("_k", F.posexplode(_shingles(F.col("w"), j)).alias("p", "h")) for j in lengths]
    known = grams.select("h").distinct()
    if blocks > 1:
        every = [x.where(F.pmod("h", F.lit(blocks)) == i) for x in every for i in range(blocks)]
    placed = [x.join(F.broadcast(known.where(F.pmod("h", F.lit(blocks)) == k % blocks)), "h", "left_semi") for k, x in enumerate(every)]
    placed = common.materialize(reduce(DataFrame.unionByName, placed), "decon-places")
    often = common.materialize(placed.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "decon-rarity")
    # The rarest shingle of each window; a window with a shingle that the corpus lacks can't occur.
    ranked = grams.join(common.sized_broadcast(often, n_grams), "h", "left")
    prefix = ranked.groupBy("window", "len").agg(F.min(F.coalesce("often", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("often", F.lit(0)), "h", "o")).alias("m")).where("least > 0").select(F.col("m.h").alias("h"), F.col("m.o").alias("o"), "len", "window")
    prefix = common.materialize(prefix, "decon-prefix")
    # Pass two: only prefix shingles join; positional and length bounds.
    start = (F.col("p") - F.col("o")).alias("s")
    cand = placed.join(common.sized_broadcast(prefix), "h").select("_k", start, "len", "window").where("s >= 0")
    cand = common.materialize(cand.groupBy("_k").agg(F.collect_set(F.struct("s", "len", "window")).alias("cand")), "decon-candidates")
    ids = common.sized_broadcast(cand.select("_k"))
    texts = docs.select(key, F.col(text_col).alias("_t")).join(ids, "_k", "left_semi").dropDuplicates(["_k"]).select("_k", words(F.col("_t")).alias("w"))
    found = F.filter("cand", lambda c: (c["s"] + c["len"] <= F.size("w")) & (F.array_join(F.slice(F.col("w"), c["s"] + 1, c["len"]), " ") == c["window"]))
    found = texts.join(cand, "_k").select("_k", found.alias("found")).where(F.size("found") > 0)
    spans = F.array_sort(F.transform("found", lambda c: F.struct(c["s"].alias("s"), (c["s"] + c["len"]).alias("e"))))
    cover = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")))["n"]
    hits = common.materialize(found.select("_k", cover.cast("long").alias("n_hit"), F.array_distinct(F.transform("found", lambda c: c["window"])).alias("windows")), "decon-hits")
    owners = common.sized_broadcast(of_items.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")), n_windows)
    items = hits.select("_k", F.explode("windows").alias("window")).join(owners, "window").select("_k", "item").distinct()
    items = items.groupBy("_k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = hits.select("_k", "n_hit").join(items, "_k", "left").select("_k", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    result = common.sized_broadcast(common.materialize(result, "decon-result"))
    common.discard(of_items, grams, placed, often, prefix, cand, hits)
    judged = base.join(result, "_k", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(*rest, "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def word_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({common.lower_sql(column)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def sql(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {word_sql("text")} AS w FROM {docs}),
b AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, {word_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[o + 1:o + l], ' ') AS t FROM (SELECT item_id, w, l, unnest(range(len(w) - l + 1)) AS o FROM b)),
ls AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, s, array_to_string(w[s + 1:s + l], ' ') AS t FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS s FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, s, l, item_id FROM dw JOIN win USING (l, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       coalesce(its.h, sha256('')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
