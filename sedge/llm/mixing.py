"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame operations only.

Targets share all tokens by weight, no source above `most` times its own (water filling). Blocks of `block` tokens go to
sources by highest quotients target / (2 q + 1), then a source's blocks to its shards in the same way by the shards'
tokens. A shard is a bounded set of documents, picked by a seeded hash of the id. In a shard, documents stand in seeded
order and form one stream of blocks; its quota takes the stream whole as often as it fits, then the first blocks of it.

Order and quotas are worked out on (source, hash, id, size) rows. What documents need to know of their shard is where its
last block ends: one row for each shard, so that no text is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 16, 20260101
#: A shard's least tokens and rows; the sum of shards stays under about SHARDS, so that shards grow beyond these.
SHARD_WORDS, SHARD_ROWS, SHARDS = 1 << 17, 512, 1 << 16


def size_of(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, ... and target. One row per source comes in; the window over them is that small.

    In ascending order of cap / weight, a source is capped while its cap is at most its share of what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1)
    x = sources.withColumn("_w", w.cast("long")).withColumn("_cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    left_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    x = x.withColumn("_level", left / left_w)
    x = x.withColumn("_open", F.col("_cap") > F.col("_w") * F.col("_level"))
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(everything)
    x = x.withColumn("target", F.when(F.col("_open"), F.col("_w") * level).otherwise(F.col("_cap")).cast("double"))
    return x.drop("_w", "_cap", "_level", "_open")


def sainte_lague(df: DataFrame, group: list[str], key: list[str], votes: str, total: Column, seats: Column, out: str) -> DataFrame:
    """df with the seats of each row by highest quotients votes / (2 q + 1) within its group.

    total: the group's votes, seats: its seats. Rounding votes * seats / total is right but for the last few seats; only
    those quotients are ranked, about three a row and not one a seat. Ties go by key.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    x = df.withColumn("_q", F.floor(share * seats + 0.5).cast("long")).withColumn("_m", (F.ceil(share * n) + 2).cast("long"))
    x = x.withColumn("_d", seats.cast("long") - F.sum("_q").over(Window.partitionBy(*group)))
    steps = F.when(F.col("_d") > 0, F.sequence(F.lit(0).cast("long"), F.col("_m"))).when(F.col("_d") < 0, F.sequence(F.lit(-1).cast("long"), -F.least(F.col("_m"), F.col("_q")))).otherwise(F.array().cast("array<bigint>"))
    steps = F.when((F.col("_d") < 0) & (F.col("_q") < 1), F.array().cast("array<bigint>")).otherwise(steps)
    y = x.select(*group, *key, F.col(votes).alias("_v"), "_q", "_d", F.explode(steps).alias("_i"))
    y = y.withColumn("_quot", F.col("_v") / (2 * (F.col("_q") + F.col("_i")) + 1))
    add = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(F.col("_d") > 0, -F.col("_quot")).otherwise(F.col("_quot")), *(F.col(k).asc_nulls_last() for k in key), F.abs(F.col("_i"))))
    y = y.withColumn("_r", add).where("_r <= abs(_d)").groupBy(*group, *key).agg(F.sum(F.signum("_d")).cast("long").alias("_more"))
    on = list(dict.fromkeys([*group, *key]))
    y = y.select(*(F.col(c).alias(f"_y_{c}") for c in on), "_more")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_y_{c}")) for c in on))
    return x.join(y, same, "left").select(*df.columns, (F.col("_q") + F.coalesce("_more", F.lit(0))).alias(out))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs and size, source_size, target, taken (columns of these names are replaced).

    Null sources are one source, the last; null and blank texts have size 0 and are never taken. Rows that repeat are
    each a document of the mix. Equal ids fall together in the seeded order and then go by size; where a quota ends among
    rows of equal id and size, each takes the same, and the rest of fewer words than such rows is left. An empty table gives
    no rows. Texts of any length count whole. The tables of sources and of shards (one row each, under about 2 * SHARDS and
    the sources) are broadcast only up to common.BROADCAST_ROWS.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "taken"]
    rest = [c for c in docs.columns if c not in new]
    place = F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("lot"), F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"))
    sized = docs.select(F.col(source_col).alias("source"), place.alias("_at"))
    sized = common.materialize(sized.select("source", "_at", F.col("_at.size").alias("size")), "mix-sizes")
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    aimed = targets(by_source, weights, most).withColumn("_all", F.lit(0))
    aimed = sainte_lague(aimed, ["_all"], ["source"], "target", F.lit(float(total)), F.lit(round(total / block)), "_blocks").drop("_all")
    words, count = max(SHARD_WORDS, total // SHARDS), max(SHARD_ROWS, rows // SHARDS)
    aimed = aimed.withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / words), F.ceil(F.col("_rows") / count), F.lit(1)).cast("long")).drop("_rows")
    aimed = common.materialize(aimed, "mix-sources")
    n_sources = aimed.count()

    def with_source(df: DataFrame, column: str) -> DataFrame:
        side = aimed.select(*(F.col(c).alias(f"_s_{c}") for c in aimed.columns))
        return df.join(common.sized_broadcast(side, n_sources), df[column].eqNullSafe(side["_s_source"]))

    shard = F.pmod(F.col("_at.lot"), F.col("_s__shards")).alias("_shard")
    dealt = with_source(sized, "source")
    shards = dealt.groupBy("source", shard).agg(F.sum("size").alias("_w"), F.first("_s_source_size").alias("_s"), F.first("_s__blocks").alias("_b"))
    shards = sainte_lague(shards, ["source"], ["_shard"], "_w", F.col("_s"), F.col("_b"), "_q")
    take = F.least(F.col("_q") * block, F.col("_w") * most)
    whole = F.when(F.col("_w") > 0, F.expr("_take div _w")).otherwise(F.lit(0))
    shards = shards.select(F.col("source").alias("_src"), F.col("_shard").alias("_sh"), "_w", take.alias("_take"))
    shards = common.materialize(shards.select("_src", "_sh", whole.alias("_whole"), (F.col("_take") - whole * F.col("_w")).alias("_rest")), "mix-shards")

    # Where the last round of a shard ends: at the first place by which more words than are left have passed.
    order = Window.partitionBy("source", "_shard").orderBy("_at")
    past = F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    alike = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    stream = dealt.select("source", shard, "_at", "size").withColumns({"_past": past, "_n": alike})
    passed = stream.join(common.sized_broadcast(shards), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_shard") == F.col("_sh"))).where("_past > _rest")
    edge = F.min(F.struct("_at", F.expr("(_rest - (_past - size * _n)) div _n").alias("part"))).alias("_edge")
    ends = passed.groupBy("_src", "_sh").agg(edge, F.first("_whole").alias("_whole"))
    ends = common.materialize(shards.select("_src", "_sh").join(ends.withColumnsRenamed({"_src": "_e", "_sh": "_es"}), F.col("_src").eqNullSafe(F.col("_e")) & (F.col("_sh") == F.col("_es")), "left").select("_src", "_sh", "_edge", "_whole"), "mix-ends")

    full = with_source(docs.select(*rest, place.alias("_at")), source_col)
    side = common.sized_broadcast(ends)
    full = full.join(side, full[source_col].eqNullSafe(side["_src"]) & (shard == side["_sh"]), "left")
    size = F.col("_at.size")
    part = F.when(F.col("_at") < F.col("_edge._at"), size).when(F.col("_at") == F.col("_edge._at"), F.col("_edge.part")).otherwise(F.lit(0))
    common.discard(sized, shards)
    return full.select(*rest, size.alias("size"), F.col("_s_source_size").alias("source_size"), F.col("_s_target").alias("target"), (F.coalesce("_whole", F.lit(0)) * size + part).cast("long").alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
