"""Exact dedup: two-pass Bloom filtering.

Pass one folds a 64-bit hash of each text into a filter of hashes that may occur twice. Pass two tests each row: a row
whose hash is surely alone goes straight through as its own group, without a shuffle; the rest are grouped by SHA-256.
The filter's size follows the row count up to 16 MB (common.bits_for); beyond that it only lets more rows into the
shuffle, and results stay the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """All columns of docs and keep_id, group_size, kept, text_sha256 (any columns of these names are replaced).

    Texts are equal when identical byte for byte; null counts as the empty text, and empty texts are a group like any
    other. Of a group the row with the largest id stays (`keep="smallest"`: the smallest). Rows that repeat an id with
    the same text all count in group_size and are kept or dropped together. A null id stays only if its whole group has
    null ids; then keep_id is null, and all of the group are kept, as nothing tells them apart. An empty table gives no
    rows. Texts of any length are hashed whole.
    """
    spark = docs.sparkSession
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(*rest).withColumns({"_sha": F.sha2(text, 256), "_h": F.xxhash64(text)})
    bits = common.bits_for(docs.select(id_col).count(), per_key=16)
    seen = spark.sparkContext.broadcast(common.build_bloom(docs.select(F.xxhash64(text).alias("h")), bits, repeated=True))

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(common.bloom_has(seen.value, h.to_numpy()))

    flagged = hashed.withColumn("_maybe", maybe("_h"))
    alone = flagged.where(~F.col("_maybe")).select(*rest, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    cand = flagged.where("_maybe")
    pick = F.max(id_col) if keep == "largest" else F.min(id_col)
    # Written, so that the join has a plain exchange on both sides and Spark can split a hot text's partition.
    groups = common.materialize(cand.groupBy("_sha").agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = cand.join(groups, "_sha").select(*rest, "keep_id", "group_size", F.coalesce(F.col(id_col).eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(joined)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
