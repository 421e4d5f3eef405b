"""The dependency graph: building it, reading it (DOM-8, AGG-3..8, GQ-1..12, JOIN-5..10, PRJ-6, SNK-6).

Files, import edges and use edges are tables; the other nodes and edges follow from them. All functions work on many
repositories at once unless a repository_id is given. Reads are ordered and limited as SRT-7 and SRT-9 say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import imports as imp

EDGE_LIMIT, CENTRAL_LIMIT, DIRECT_LIMIT = 50, 20, 10


@dataclass(frozen=True)
class Graph:
    """files (repository_id, path, name, module, is_service), imports and uses (repository_id, source, target)."""

    files: DataFrame
    imports: DataFrame
    uses: DataFrame

    def of(self, repository_id: str) -> Graph:
        own = F.col("repository_id") == repository_id
        return Graph(self.files.where(own), self.imports.where(own), self.uses.where(own))


def file_nodes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select("repository_id", path, paths.basename(path).alias("name"), paths.module(path).alias("module"), paths.is_service(path).alias("is_service"))


def module_uses(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct pairs of different modules whose files import each other; both ends must be nodes (FLT-8, SET-2)."""
    m = files.select("repository_id", "path", "module")
    x = edges.join(m.select("repository_id", F.col("path").alias("source"), F.col("module").alias("sm")), ["repository_id", "source"])
    x = x.join(m.select("repository_id", F.col("path").alias("target"), F.col("module").alias("tm")), ["repository_id", "target"])
    return x.where("sm <> tm").select("repository_id", F.col("sm").alias("source"), F.col("tm").alias("target")).distinct()


def build(tree: DataFrame) -> Graph:
    """The graph of repotree rows."""
    source = tree.where(F.col("kind") == "file").where(paths.for_graph(F.col("name"), F.col("dir_parts")))
    files = file_nodes(source.select("repository_id", "path"))
    edges = imp.resolve(imp.extract(source.select("repository_id", "path", "content")), files)
    return Graph(files, edges, module_uses(edges, files))


def existing(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with a node at both ends (JOIN-10)."""
    n = nodes.select("repository_id", F.col(key).alias("_n")).distinct()
    for end in ("source", "target"):
        edges = edges.join(n.withColumnRenamed("_n", end), ["repository_id", end], "left_semi")
    return edges.select("repository_id", "source", "target")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and what old has under other keys; repeated keys in new count once (SET-3)."""
    new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


# ---------------------------------------------------------------- reads


def stats(g: Graph) -> DataFrame:
    """repository_id and the five counts; a repository without edges has zeros (AGG-3)."""
    f = g.files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_nodes"), F.count_distinct("module").alias("module_nodes"), F.count_if("is_service").alias("service_nodes"))
    i = g.imports.groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_import_relationships"))
    u = g.uses.groupBy("repository_id").agg(F.count(F.lit(1)).alias("module_use_relationships"))
    return f.join(i, "repository_id", "left").join(u, "repository_id", "left").fillna(0, ["file_import_relationships", "module_use_relationships"])


def file_count(g: Graph) -> DataFrame:
    """One row, 0 if there are none (GQ-6)."""
    return g.files.agg(F.count(F.lit(1)).alias("files"))


def module_count(g: Graph) -> DataFrame:
    """One row, 0 if there are none (GQ-7)."""
    return g.files.agg(F.count_distinct("module").alias("modules"))


def file_paths(g: Graph) -> DataFrame:
    """path of all source files, in order (SRC-2, SRT-1)."""
    return g.files.select("path").orderBy("path")


def modules(g: Graph) -> DataFrame:
    """name, in order (GQ-8)."""
    return g.files.select(F.col("module").alias("name")).distinct().orderBy("name")


def files_in_module(g: Graph, module: str | Column) -> DataFrame:
    """Base names, repeated ones kept, in order (GQ-9)."""
    return g.files.where(F.col("module") == module).select("name").orderBy("name")


def module_dependencies(g: Graph, module: str | Column) -> DataFrame:
    """name of what a module uses, in order (GQ-10)."""
    return g.uses.where(F.col("source") == module).select(F.col("target").alias("name")).orderBy("name")


def imported_files(g: Graph, limit: int | None = EDGE_LIMIT) -> DataFrame:
    """source, target in order (GQ-1)."""
    x = g.imports.select("source", "target").orderBy("source", "target")
    return x if limit is None else x.limit(limit)


def used_modules(g: Graph, limit: int | None = EDGE_LIMIT) -> DataFrame:
    """source, target in order (GQ-2); without limit all module dependencies (GQ-12)."""
    x = g.uses.select("source", "target").orderBy("source", "target")
    return x if limit is None else x.limit(limit)


def services(g: Graph, limit: int | None = EDGE_LIMIT) -> DataFrame:
    """service (its path) and module (GQ-3); a service is implemented in the file of its path."""
    x = g.files.where("is_service").select(F.col("path").alias("service"), "module").orderBy("service")
    return x if limit is None else x.limit(limit)


def central_files(g: Graph, limit: int | None = DIRECT_LIMIT) -> DataFrame:
    """file and imports, its number of importers, most first (GQ-4, GQ-5); ties by path."""
    x = g.imports.groupBy(F.col("target").alias("file")).agg(F.count("source").alias("imports")).orderBy(F.desc("imports"), "file")
    return x if limit is None else x.limit(limit)


def imports_of(g: Graph, path: str) -> DataFrame:
    """What a file imports (GQ-12)."""
    return g.imports.where(F.col("source") == path).select(F.col("target").alias("file")).orderBy("file")


def importers_of(g: Graph, path: str) -> DataFrame:
    """What imports a file (GQ-12)."""
    return g.imports.where(F.col("target") == path).select(F.col("source").alias("file")).orderBy("file")


def context(g: Graph) -> dict[str, DataFrame]:
    """The four reads that describe a graph (GQ-11)."""
    return {"imported_files": imported_files(g), "module_uses": used_modules(g), "services": services(g), "central_files": central_files(g, CENTRAL_LIMIT).withColumnRenamed("imports", "import_count")}
