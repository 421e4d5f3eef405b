"""`repotree`: a data source of the directories and files of source trees (SRC-2..5, FLT-1, PRJ-1).

Spark's file sources leave out names that start with `_` or `.` and empty files, so trees are walked here. One partition
holds one entry at a root's top; executors walk below it. Directories that all users ignore are never entered, symbolic
links to directories are rows but are not followed. Filters on kind and repository_id are pushed down.

Options: `path` and `repository_id` of one tree, or `roots`: a JSON list of [repository_id, path]; `content`: `false`
leaves file contents out. Trees must be on a file system that driver and executors share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.paths import IGNORED_ALWAYS
from ..schemas import TREE

#: Bounds of an Arrow batch that a partition gives.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22


class _Part(InputPartition):
    def __init__(self, repository_id: str, root: str, entry: str):
        self.repository_id, self.root, self.entry = repository_id, root, entry


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self):  # noqa: ANN201
        return TREE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"]) if "roots" in options else [[options.get("repository_id", ""), options["path"]]]
        self.content = str(options.get("content", "true")).lower() != "false"
        self.kind: str | None = None
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kind = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("repository_id",):
                self.only = f.value
            yield f  # Spark checks again

    def partitions(self) -> list[_Part]:
        out = []
        for repository_id, root in self.roots:
            if self.only is not None and repository_id != self.only:
                continue
            for name in sorted(os.listdir(root)):
                if name not in IGNORED_ALWAYS or not os.path.isdir(os.path.join(root, name)):
                    out.append(_Part(repository_id, root, name))
        return out or [_Part("", "", "")]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        """Batches of some BATCH_BYTES of contents or BATCH_ROWS rows; a list of rows would hold 10,000 files."""
        rows, size = [], 0
        for row in self._rows(part):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = to_arrow_schema(TREE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, part: _Part) -> Iterator[tuple]:
        if not part.root:
            return
        top = os.path.join(part.root, part.entry)
        if not os.path.isdir(top):
            yield from self._row(part, part.entry, "file")
            return
        yield from self._row(part, part.entry, "directory")
        if os.path.islink(top):
            return
        for where, dirs, files in os.walk(top):
            dirs[:] = sorted(d for d in dirs if d not in IGNORED_ALWAYS)
            base = os.path.relpath(where, part.root).replace(os.sep, "/")
            for d in dirs:
                yield from self._row(part, f"{base}/{d}", "directory")
            for f in sorted(files):
                yield from self._row(part, f"{base}/{f}", "file")

    def _row(self, part: _Part, path: str, kind: str) -> Iterator[tuple]:
        if self.kind is not None and kind != self.kind:
            return
        *above, name = path.split("/")
        size = content = None
        if kind == "file":
            try:
                full = os.path.join(part.root, path)
                size = os.stat(full).st_size
                if self.content:
                    with open(full, "rb") as f:
                        content = f.read()
            except OSError:
                pass  # it counts as a file, without content
        yield part.repository_id, path, name, above, kind, size, content
