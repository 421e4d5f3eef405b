"""Text to vector (EMB-1..3): an embedder is built once in each Python worker and gets slices of Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

#: Rows that an embedder gets at a time.
ROWS = 512


class Embedder(Protocol):
    dims: int

    def encode(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class HashingEmbedder:
    """Signed counts of words by hash, unit length; needs no model and gives the same vectors everywhere.

    A word's cell and sign come from its MD5, which is kept for later texts; some PART characters are counted at a time, so
    that memory is bounded whatever the number and length of texts.
    """

    #: Characters counted at a time; bytes of kept words, roughly.
    PART, KEPT = 1 << 18, 1 << 24
    #: Parts of words as in camelCase; the same in RE2, Java and Python.
    WORD = "[A-Za-z][a-z]*|[0-9]+|[^\\x00-\\x7F]+"
    _LOWER = {i: i + 32 for i in range(65, 91)}
    #: What no word goes on with, so that a text may be cut before it.
    _END = re.compile("[\\x00-/:-`{-\\x7f]")

    def __init__(self, dims: int = 384):
        self.dims, self._word = dims, re.compile(self.WORD)
        self._cells: dict[str, int] = {}
        self._kept = 0

    def _cell(self, word: str) -> int:
        """Twice the cell, and 1 for a positive sign."""
        h = int(hashlib.md5(word.translate(self._LOWER).encode(), usedforsecurity=False).hexdigest()[:8], 16)
        return (h >> 1) % self.dims * 2 + (h & 1)

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Rows and pieces of texts, some PART characters together; longer texts are cut between words."""
        rows, pieces, size = [], [], 0
        for row, t in enumerate(texts):
            at = 0
            while at < len(t):
                end = self._END.search(t, at + self.PART)
                stop = end.start() if end else len(t)
                rows.append(row)
                pieces.append(t[at:stop])
                size, at = size + stop - at, stop
                if size >= self.PART:
                    yield rows, pieces
                    rows, pieces, size = [], [], 0
        if rows:
            yield rows, pieces

    def _learn(self, words: set[str]) -> None:
        fresh = words - self._cells.keys()
        if self._kept > self.KEPT:
            self._cells, self._kept, fresh = {}, 0, words
        self._cells.update((w, self._cell(w)) for w in fresh)
        self._kept += sum(len(w) + 100 for w in fresh)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        v = np.zeros((len(texts), self.dims))
        for rows, pieces in self._parts(texts):
            found = [self._word.findall(p) for p in pieces]
            self._learn(set().union(*found))
            cell = np.fromiter(map(self._cells.__getitem__, chain.from_iterable(found)), np.int64)
            first, n = rows[0], rows[-1] - rows[0] + 1
            row = np.repeat(np.asarray(rows) - first, [len(f) for f in found])
            v[first : first + n] += np.bincount(row * self.dims + (cell >> 1), weights=np.where(cell & 1, 1.0, -1.0), minlength=n * self.dims).reshape(n, self.dims)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return list(np.divide(v, n, out=v, where=n > 0))


def sentence_transformer(model: str = "all-MiniLM-L6-v2") -> Embedder:
    """The embedder of a sentence-transformers model, where that package is installed."""
    from sentence_transformers import SentenceTransformer

    class Wrapped:
        def __init__(self) -> None:
            self.model = SentenceTransformer(model)
            self.dims = self.model.get_sentence_embedding_dimension()

        def encode(self, texts: list[str]) -> list[list[float]]:
            return self.model.encode(texts, convert_to_numpy=True).tolist() if texts else []

    return Wrapped()


def embed(df: DataFrame, text_col: str = "content", make: Callable[[], Embedder] = HashingEmbedder, out: str = "embedding") -> DataFrame:
    """df with the vector of its text, on the same row (JOIN-12); null for a null text.

    An Arrow batch is worked in slices of ROWS rows and vectors stay arrays, so that a worker's memory hardly depends on it.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                texts = batch.slice(at, ROWS)
                got = embedder.encode(texts.drop_null().to_pylist())
                flat = np.concatenate([np.asarray(v, np.float64) for v in got]) if len(got) else np.zeros(0)
                ends = np.zeros(len(texts) + 1, np.int32)
                ok = texts.is_valid().to_numpy(zero_copy_only=False)
                ends[1:][ok] = [len(v) for v in got]
                yield pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat), mask=pa.array(~ok))

    return df.withColumn(out, vectors(text_col))
