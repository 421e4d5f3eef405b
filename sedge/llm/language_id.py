"""Language identification: nearest centroid of TF-IDF n-gram vectors, several clustered centroids per language.

A text becomes the hashed counts of its byte n-grams (1 to 3 bytes; ASCII folded to lower case, other ASCII signs to
blanks), square-rooted, weighted by inverse document frequency and normalised. Each language's training vectors are
clustered by spherical k-means; a text gets the language of the centroid with the largest cosine. It is rejected if that
cosine is under the language's limit for texts of its length: SLACK times the LOW quantile of its training texts of such a
length, by number of n-grams (LENGTHS); of fewer than FEW such texts, SLACK times the least cosine of all of the language's.

Training takes about SAMPLE rows at most, shared over the languages and picked by a hash of the id, and the LANGUAGES most
frequent languages at most: that bounds what reaches the driver and the broadcast model (languages * CLUSTERS * DIMS floats).
Prediction covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS, GRAMS, CLUSTERS, SAMPLE, LANGUAGES, SEED = 1 << 13, (1, 2, 3), 3, 4000, 1000, 5
SLACK, LOW, LENGTHS, FEW = 0.6, 0.01, (100, 300, 1000), 10
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Bytes of text that one call of vectors() works on; a longer text is cut into pieces whose counts add up.
_PIECE, _ROWS = 1 << 20, 128


def _count(b: np.ndarray, row: np.ndarray, rows: int, dims: int, lead: int = 0) -> np.ndarray:
    """Hashed counts of the n-grams of folded bytes, by row; of those that end at `lead` or later."""
    out = np.zeros((rows, dims), np.float32)
    b = b.astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n not in GRAMS:
            continue
        ok = (row[:m] == row[n - 1 :]) & ~((b[:m] == 32) & (b[min(1, n - 1) : m + min(1, n - 1)] == 32))
        if n == 3:
            ok &= ~((b[1 : m + 1] == 32) & (b[2 : m + 2] == 32))
        ok[: max(0, lead - n + 1)] = False
        h = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = row[:m][ok] * dims + (h[ok] >> np.uint32(32 - int(np.log2(dims))))
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
    return out


def count_grams(parts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Row i: hashed n-gram counts of the i-th text, with a blank at both ends."""
    joined = b"".join(b" " + p.translate(_FOLD) + b" " for p in parts)
    row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) + 2 for p in parts])
    return _count(np.frombuffer(joined, np.uint8), row, len(parts), dims)


def vectors(texts: list[bytes], dims: int = DIMS) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for runs of rows; memory is bounded by _ROWS rows and about _PIECE bytes beside the texts."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and j - i < _ROWS and (j == i or total + len(texts[j]) <= _PIECE):
            total += len(texts[j])
            j += 1
        if j == i + 1 and total > _PIECE:
            folded = b" " + texts[i].translate(_FOLD) + b" "
            whole = np.zeros((1, dims), np.float32)
            for k in range(0, len(folded), _PIECE):  # each n-gram counts in the piece that it ends in
                lead = min(k, max(GRAMS) - 1)
                part = np.frombuffer(folded[k - lead : k + _PIECE], np.uint8)
                whole += _count(part, np.zeros(len(part), np.int64), 1, dims, lead)
            yield i, whole
        else:
            yield i, count_grams(texts[i:j], dims)
        i = j


def tf(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts)


def normalise(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; fewer centroids for fewer rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = normalise(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(k)]).astype(np.float32))
    return c


def length_class(counts: np.ndarray) -> np.ndarray:
    """The place of each row's number of n-grams among LENGTHS."""
    return np.searchsorted(LENGTHS, counts.sum(1), "right")


def limits(cosine: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By length class, from a language's training texts: their cosines and length classes."""
    own = [cosine[length == i] for i in range(len(LENGTHS) + 1)]
    return SLACK * np.array([np.quantile(c, LOW) if len(c) >= FEW else cosine.min() for c in own])


class Model:
    """idf, centroids, their languages and the cosines under which each rejects, by length."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, limit: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.limit = langs, idf, centroids, owner, limit

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        return normalise(tf(counts) * self.idf) @ self.centroids.T


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, clusters: int = CLUSTERS, seed: int = SEED) -> Model | None:
    """Learn from rows with a language and a letter; None if there are none.

    Of languages of equal count the first by name are kept. Rows that repeat an id are picked or left together; which rows
    are picked, and in which order they are clustered, hangs on ids and texts only. Null ids share one hash.
    """
    common.bound_batches(rows.sparkSession)
    good = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    most = good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    count = {r["lang"]: r["n"] for r in most.collect()}
    if not count:
        return None
    if len(count) == LANGUAGES:
        good = good.where(F.col("lang").isin(*count))
    quota = max(1, sample // len(count))
    scale = 1 << 20
    share = F.lit(scale)
    for lang, n in sorted(count.items()):
        if n > quota:
            share = F.when(F.col("lang") == lang, F.lit(int(np.ceil(scale * quota / n)))).otherwise(share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() for t in b.column("text").cast(pa.binary())]
            for i, counts in vectors(texts):
                at = [np.flatnonzero(r).astype(np.uint16) for r in counts]
                yield pa.RecordBatch.from_pydict({"lang": b.column("lang").slice(i, len(counts)), "h": b.column("h").slice(i, len(counts)), "at": [a.tobytes() for a in at], "n": [r[a].tobytes() for r, a in zip(counts, at, strict=True)]})

    got = good.where(F.pmod("h", F.lit(scale)) < share).mapInArrow(features, "lang string, h long, at binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"], r["at"], r["n"]))
    if not got:
        return None
    seen = np.zeros(DIMS, np.int64)
    for r in got:
        seen[np.frombuffer(r["at"], np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    langs = sorted({r["lang"] for r in got})
    centroids, owner, limit = [], [], []
    for k, lang in enumerate(langs):  # one language's vectors at a time are dense on the driver
        rows = [r for r in got if r["lang"] == lang]
        own = np.zeros((len(rows), DIMS), np.float32)
        for i, r in enumerate(rows):
            own[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
        length = length_class(own)
        for i in range(0, len(own), _ROWS):
            own[i : i + _ROWS] = normalise(tf(own[i : i + _ROWS]) * idf)
        c = k_means(own, clusters, seed)
        centroids.append(c)
        owner += [k] * len(c)
        limit += [limits((own @ c.T).max(1), length)] * len(c)
    return Model(langs, idf, np.concatenate(centroids), np.array(owner), np.array(limit, np.float32))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score, rejected (columns of these names are replaced).

    lang_pred is `und`, score 0 and rejected true for null texts, texts without a letter and without a model. A text
    whose letters give no n-gram weight has cosine 0 with all centroids and gets the first language, rejected. Equal
    cosines go to the first centroid by language. Repeated rows are each predicted. Texts of any length are counted whole.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    common.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        m = sent.value
        pred, score, off = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if m is not None:
            at = np.flatnonzero(texts.notna().to_numpy())
            for i, counts in vectors([texts.iat[k].encode("utf-8", "surrogatepass") for k in at]):
                cos = m.cosines(counts)
                best = cos.argmax(1)
                rows = at[i : i + len(counts)]
                pred[rows] = np.array(m.langs, object)[m.owner[best]]
                score[rows] = np.clip(cos.max(1), 0, 1)
                off[rows] = cos.max(1) < m.limit[best, length_class(counts)]
        return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": off})

    out = docs.select(*rest).withColumn("_p", predict(F.when(has_letter(F.col(text_col)), F.col(text_col))))
    return out.select(*rest, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.rejected").alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained_on(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out."""
    return fit(docs.where(~held_out()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs.select("doc_id", "text"), trained_on(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
