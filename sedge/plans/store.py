"""Stored relations (SNK-1..10, CRUD-1, SRT-4, SRT-5, SRT-8, SRC-9, SRC-10, FLT-6, JOIN-13, DT-1, ID-1).

Parquet under one root. The index tables are partitioned by repository_id and written with dynamic partition overwrite,
so that indexing again replaces a repository's rows. Each write goes to a new run folder that no reader looks at until
the run's row is in `commits`: readers see all tables of a run or none.
"""

from __future__ import annotations

import datetime as dt
import uuid
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..errors import AskError, GraphError
from ..operators import graph


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ reading

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table by its fixed schema; empty if nothing has been written."""
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def repositories(self) -> DataFrame:
        """One row for each url: should two jobs have added it at once, the first by time and id counts for all readers."""
        names = schemas.REPOSITORIES.names
        first = F.min_by(F.struct(*names), F.struct("created_at", "id")).alias("r")
        return self.read("repositories", schemas.REPOSITORIES).groupBy("repo_url").agg(first).select(*(F.col(f"r.{n}").alias(n) for n in names))

    def reports(self) -> DataFrame:
        return self.read("reports", schemas.REPORTS)

    def latest_run(self, repository_id: str | None = None) -> DataFrame:
        """repository_id, run: the last committed one of each."""
        c = self.read("commits", schemas.COMMITS)
        if repository_id is not None:
            c = c.where(F.col("repository_id") == repository_id)
        return c.groupBy("repository_id").agg(F.max_by("run", F.struct("at", "run")).alias("run"))

    def table(self, name: str, repository_id: str | None = None) -> DataFrame:
        """Committed rows of an index table. One repository's rows come from its own folders (partition pruning)."""
        schema = schemas.TABLES[name]
        stored = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        df = self.read(name, stored)
        if repository_id is not None:
            run = self.latest_run(repository_id).first()
            return df.where((F.col("repository_id") == repository_id) & (F.col("run") == (run["run"] if run else ""))).select(*schema.names)
        return df.join(self.latest_run(), ["repository_id", "run"], "left_semi").select(*schema.names)

    def chunks(self, repository_id: str) -> DataFrame:
        """A repository's chunks in file and chunk order (SRT-5)."""
        return self.table("chunks", repository_id).orderBy("file_path", "chunk_index")

    def graph(self, repository_id: str | None = None) -> graph.Graph:
        return graph.Graph(*(self.table(t, repository_id) for t in ("graph_files", "graph_imports", "graph_uses")))

    def repository(self, repository_id: str) -> dict:
        row = self.repositories().where(F.col("id") == repository_id).limit(1).first()
        if row is None:
            raise AskError("No such repository.")
        return row.asDict(recursive=True)

    def repository_by_url(self, url: str) -> dict | None:
        row = self.repositories().where(F.col("repo_url") == url).limit(1).first()
        return row.asDict(recursive=True) if row else None

    def latest_reports(self) -> DataFrame:
        """The latest report of each repository."""
        return latest(self.reports(), ["repository_id"], "created_at", "id")

    def latest_report(self, repository_id: str) -> dict:
        row = latest(self.reports().where(F.col("repository_id") == repository_id), ["repository_id"], "created_at", "id").first()
        if row is None:
            raise AskError("The repository has no report yet.")
        return row.asDict(recursive=True)

    # ------------------------------------------------------------ writing

    def _ids(self, urls: list[str]) -> dict[str, str]:
        asked = self.spark.createDataFrame([(u,) for u in urls], "repo_url string")
        side = F.broadcast(asked) if len(urls) <= 100_000 else asked
        return {r["repo_url"]: r["id"] for r in self.repositories().join(side, "repo_url", "left_semi").select("repo_url", "id").collect()}

    def get_or_create(self, urls: list[str]) -> dict[str, str]:
        """Ids by url; urls that aren't known yet are appended with fresh ids, and read again, so that all jobs agree (SNK-1)."""
        urls = list(dict.fromkeys(urls))
        known = self._ids(urls)
        fresh = [(str(uuid.uuid4()), u, now(), now()) for u in urls if u not in known]
        if fresh:
            self.spark.createDataFrame(fresh, schemas.REPOSITORIES).coalesce(1).write.mode("append").parquet(f"{self.root}/repositories")
            known = self._ids(urls)
        return known

    def append_reports(self, reports: DataFrame) -> None:
        """Rows of metadata.reports get an id and a time (SNK-2)."""
        at = F.lit(now()).cast("timestamp_ntz")
        reports.withColumns({"id": F.uuid(), "created_at": at}).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.REPORTS.fields)).write.mode("append").parquet(f"{self.root}/reports")

    def replace(self, run: str, tables: dict[str, DataFrame]) -> None:
        """Write index tables of a run; nothing is visible before commit() (SNK-4, SNK-6)."""
        for name, df in tables.items():
            df.select(*schemas.TABLES[name].names).withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id", "run").parquet(f"{self.root}/{name}")

    def store_graph(self, run: str, g: graph.Graph) -> DataFrame:
        """Write a run's graph; its counts by repository, from what was written (SNK-6, SNK-7).

        Module edges follow from the written edges, which spares the import branch a second run.
        """

        def written(name: str) -> DataFrame:
            stored = T.StructType([*schemas.TABLES[name].fields, T.StructField("run", T.StringType())])
            return self.read(name, stored).where(F.col("run") == run).drop("run")

        try:
            self.replace(run, {"graph_files": g.files, "graph_imports": g.imports})
            self.replace(run, {"graph_uses": graph.module_uses(written("graph_imports"), written("graph_files"))})
        except (PySparkException, OSError) as e:
            raise GraphError(f"The graph can't be written: {e}") from e
        return graph.stats(graph.Graph(*map(written, ("graph_files", "graph_imports", "graph_uses"))))

    def commit(self, run: str, repository_ids: list[str]) -> None:
        rows = [(r, run, now()) for r in repository_ids]
        self.spark.createDataFrame(rows, schemas.COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def delete(self, name: str, repository_id: str) -> None:
        """Drop a repository's partition of an index table (SNK-5)."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/repository_id={repository_id}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def vacuum(self) -> int:
        """Drop all runs' rows but those of each repository's last committed run; how many folders went. Not to be called while
        a run is being written: its rows are not committed yet."""
        live = {(r["repository_id"], r["run"]) for r in self.latest_run().toLocalIterator()}
        gone = 0
        for name in schemas.TABLES:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(top, "repository_id=*/run=*")) or ():
                path = found.getPath()
                key = tuple(unquote(p.getName().partition("=")[2]) for p in (path.getParent(), path))
                if key not in live:
                    fs.delete(path, True)
                    gone += 1
        return gone

    def counts(self) -> DataFrame:
        """repository_id, chunks (AGG-9)."""
        return self.table("chunks").groupBy("repository_id").agg(F.count(F.lit(1)).alias("chunks"))


def latest(df: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The row of each group with the greatest (at, tie): an aggregate, not a sort (SRT-4)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_m")).select(*by, *(F.col(f"_m.{c}").alias(c) for c in rest))


def new_repositories(known: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Rows of offered whose key isn't known, once each (SNK-1 for tables)."""
    return offered.dropDuplicates([key]).join(known.select(key), key, "left_anti")
