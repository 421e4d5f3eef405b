"""Path expressions (PRJ-1..5, PRJ-9, PTH-1, FLT-1..4, FLT-9); built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories left out of metadata and graph, and those left out of chunking; they differ.
IGNORED_METADATA = (".git", ".next", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
IGNORED_CHUNKS = (".cache", ".git", ".idea", ".next", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "node_modules", "venv")
IGNORED_ALWAYS = tuple(sorted(set(IGNORED_METADATA) & set(IGNORED_CHUNKS)))
LOCKFILES = ("Pipfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
CHUNK_SUFFIXES = (".js", ".json", ".jsx", ".md", ".py", ".sh", ".sql", ".toml", ".ts", ".tsx", ".yaml", ".yml")
CHUNK_NAMES = ("Dockerfile",)
GRAPH_SUFFIXES = (".js", ".jsx", ".py", ".ts", ".tsx")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last extension with its dot; none for `.py`, `foo.` and names without a dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    s = suffix(name)
    return F.when(s == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(s)))


def module(path: Column) -> Column:
    """First segment, or the stem of a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, stem(path)).otherwise(parts[0])


def is_service(path: Column) -> Column:
    return F.lower(stem(basename(path))).contains("service") | F.concat(F.lit("/"), F.lower(path)).contains("/services/")


def outside(dir_parts: Column, names: tuple[str, ...]) -> Column:
    """No directory on the way is one of names."""
    return ~F.arrays_overlap(dir_parts, F.array(*map(F.lit, names)))


def for_chunks(name: Column, dir_parts: Column) -> Column:
    """Files that are chunked: the suffix test ignores case (SRC-3)."""
    wanted = F.lower(suffix(name)).isin(*CHUNK_SUFFIXES) | name.isin(*CHUNK_NAMES)
    return outside(dir_parts, IGNORED_CHUNKS) & ~name.isin(*LOCKFILES) & wanted


def for_graph(name: Column, dir_parts: Column) -> Column:
    """Files that are graph nodes: the suffix test respects case (SRC-2)."""
    return outside(dir_parts, IGNORED_METADATA) & suffix(name).isin(*GRAPH_SUFFIXES)


def normalised(path: Column) -> Column:
    """Path with `.` and `..` worked out; null if it leaves the root (FLT-9)."""

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(acc.isNull() | (part == "") | (part == "."), acc)
            .when((part == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
            .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def repository_key(url: Column) -> Column:
    """`repo-` and the url's last segment in lower case without `.git` (PRJ-9)."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.concat(F.lit("repo-"), F.lower(F.replace(last, F.lit(".git"), F.lit(""))))


#: An http or https URL with a host; the same in RE2, Java and Python.
URL, URL_CHARS = r"(?i)https?://[^\s/?#]+([/?#]\S*)?", 2048


def valid_url(url: Column) -> Column:
    """A URL that a repository may have (FLT-11); false for null."""
    return F.coalesce(F.regexp_like(url, F.lit(f"^(?:{URL})$")) & (F.length(url) <= URL_CHARS), F.lit(False))
