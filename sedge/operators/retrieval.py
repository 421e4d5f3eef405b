"""Exact top-k by cosine (VEC-2, JOIN-11, SRT-6, WIN-2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector

TOP_K = 2
MAX_QUERIES = 10_000


def top_k(chunks: DataFrame, query: Sequence[float], k: int = TOP_K, keys: Sequence[str] = ("file_path", "chunk_index"), column: str = "embedding", digits: int | None = None, numpy: bool = False) -> DataFrame:
    """keys and similarity of the k nearest rows, nearest first; ties go by keys.

    Only keys and vectors are scored, so wide columns are not read; join them back by key. Plans as a top-k, not a sort.
    """
    score = vector.scorer(query)(vector.doubles(F.col(column))) if numpy else vector.cosine(F.col(column), vector.literal(query))
    score = score if digits is None else F.round(score, digits)
    return chunks.select(*keys, score.alias("similarity")).orderBy(F.desc_nulls_last("similarity"), *keys).limit(k)


def retrieve(chunks: DataFrame, repository_id: str, query: Sequence[float], k: int = TOP_K) -> DataFrame:
    """rank, similarity, file_path, chunk_index, start_line, end_line, content of a repository's k nearest chunks."""
    own = chunks.where(F.col("repository_id") == repository_id)
    best = top_k(own, query, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("similarity"), "file_path", "chunk_index")))
    # k rows: a bound for the broadcast.
    return own.join(F.broadcast(best), ["file_path", "chunk_index"]).select("rank", "similarity", "file_path", "chunk_index", "start_line", "end_line", "content").orderBy("rank")


def top_k_per_query(items: DataFrame, queries: DataFrame, k: int = TOP_K, item_key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", digits: int | None = None) -> DataFrame:
    """query_key, item_key, similarity, rank for each row of queries (query_key, column) against all items.

    Items pass once for each block of at most MAX_QUERIES queries. A block's vectors are one broadcast matrix, which Arrow
    batches of items are multiplied with; of a batch only what can be among a query's best k goes on, so no pair is a row.
    Null vectors have null similarity, last; vectors of another size are an error; ties go by item_key.
    """
    n = queries.count()
    q = queries.select(F.col(query_key), F.col(column).alias("_q"))
    if n <= MAX_QUERIES:
        blocks = [q]
    else:  # dealt by a hash, about half full, so that the bound holds
        m = -(-2 * n // MAX_QUERIES)
        blocks = [q.where(F.pmod(F.xxhash64(query_key), F.lit(m)) == i) for i in range(m)]
    near = reduce(DataFrame.unionByName, (_candidates(items, b, k, item_key, query_key, column, 0.0 if digits is None else 2.0 * 10.0**-digits) for b in blocks))
    score = (F.col("_s") if digits is None else F.round("_s", digits)).alias("similarity")
    w = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("similarity"), item_key)
    return near.select(query_key, item_key, score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _candidates(items: DataFrame, queries: DataFrame, k: int, item_key: str, query_key: str, column: str, slack: float) -> DataFrame:
    """query_key, item_key, _s: of each Arrow batch the best k items of each query, and those that come within slack of them."""
    table = queries.toArrow()
    keys, q, q_ok = table.column(0).combine_chunks(), *_matrix(table.column(1).combine_chunks())
    sent = items.sparkSession.sparkContext.broadcast((keys, q, q_ok))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, q_ok = sent.value
        for b in batches:
            v, ok = _matrix(b.column(1))
            if not len(v) or not len(q):
                continue
            if v.shape[1] != q.shape[1] and ok.any() and q_ok.any():
                raise ValueError("vectors differ in size")
            order = pc.sort_indices(b.column(0)).to_numpy()
            for i in range(0, len(q), 256):  # a bounded part of the products at a time
                s = v @ q[i : i + 256].T if v.shape[1] == q.shape[1] else np.zeros((len(v), len(q[i : i + 256])))
                s[~ok] = -np.inf
                s[:, ~q_ok[i : i + 256]] = -np.inf
                least = np.partition(s, len(s) - k, 0)[len(s) - k] if len(s) > k else np.full(s.shape[1], -np.inf)
                none = np.isneginf(least)  # fewer than k vectors: the first by key stand for the null ones
                hit = s >= least - slack
                if none.any():
                    first = np.zeros(len(s), bool)
                    first[order[:k]] = True
                    gone = np.flatnonzero(~ok)
                    first[gone[np.argsort(np.argsort(order)[gone])[:k]]] = True
                    hit[:, none] = np.isfinite(s[:, none]) | first[:, None]
                at, of = np.nonzero(hit)
                found = s[at, of]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of + i)), b.column(0).take(pa.array(at)), pa.array(found, pa.float64(), mask=np.isneginf(found))], [query_key, item_key, "_s"])

    schema = T.StructType([queries.schema[query_key], items.schema[item_key], T.StructField("_s", T.DoubleType())])
    return items.select(item_key, column).mapInArrow(near, schema)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows (zeros for null and zero ones); which are not null."""
    ok = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.unique(pc.list_value_length(vectors.drop_null()).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vectors differ in size")
    v = np.zeros((len(vectors), int(sizes[0]) if len(sizes) else 0))
    v[ok] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, v.shape[1]) if ok.any() else 0
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0), ok
