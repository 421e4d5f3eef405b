"""Import extraction and resolution (STR-8, STR-10, JOIN-1..4, FLT-7, FLT-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, udfs

JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")
PY_SUFFIXES = (".py",)


def extract(files: DataFrame) -> DataFrame:
    """repository_id, source, lang, target of files (repository_id, path, content): one row for each import found.

    Invalid UTF-8 and unparsable Python give none. Python goes through an Arrow UDF, JavaScript through a built-in regex.
    """
    x = files.select("repository_id", F.col("path").alias("source"), paths.suffix(paths.basename(F.col("path"))).alias("_s"), text.strict_utf8(F.col("content")).alias("_t"))
    py = x.where(F.col("_s") == ".py").select("repository_id", "source", F.lit("py").alias("lang"), F.explode(udfs.python_imports("_t")).alias("target"))
    js = x.where(F.col("_s").isin(*JS_SUFFIXES)).select("repository_id", "source", F.lit("js").alias("lang"), F.explode(text.js_imports(F.col("_t"))).alias("target"))
    return py.unionByName(js)


def _directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def python_base(source: Column, target: Column) -> Column:
    """Where a Python import points, without extension; absolute ones start at the root, which `..` may not leave."""
    dots = F.length(target) - F.length(F.regexp_replace(target, r"^\.+", ""))
    name = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    here = _directory(source)
    up = F.size(here) - (dots - 1)
    base = F.when(up >= 0, F.slice(here, F.lit(1), F.greatest(up, F.lit(0))))
    relative = F.when(base.isNotNull(), F.array_join(F.when(name == "", base).otherwise(F.concat(base, F.array(name))), "/"))
    return F.when(dots == 0, name).otherwise(relative)


def js_base(source: Column, target: Column) -> Column:
    """Where a relative JavaScript import points; null for package names and for what leaves the root."""
    return F.when(target.startswith("."), paths.normalised(F.concat_ws("/", F.array_join(_directory(source), "/"), target)))


def meanings(path: Column) -> Column:
    """array(struct(how, base, k)): what an import's base must be, under `py` or `js`, to mean this file, and in which place of
    the order it is tried. A base whose last segment has an extension means just the file of that path (`exact`)."""

    def cut(name: str, ahead: str) -> Column:
        return F.when(path.endswith(ahead + name) & (F.length(path) > len(ahead + name)) | (path == name), F.substring(path, F.lit(1), F.greatest(F.length(path) - len(ahead + name), F.lit(0))))

    found = [F.struct(F.lit("exact").alias("how"), path.alias("base"), F.lit(0).alias("k"))]
    for how, suffixes in (("py", PY_SUFFIXES), ("js", JS_SUFFIXES)):
        tried = [(s, "") for s in suffixes] + [(f"index{s}", "/") for s in suffixes] + [("__init__.py", "/")]
        found += [F.struct(F.lit(how).alias("how"), cut(name, ahead).alias("base"), F.lit(k).alias("k")) for k, (name, ahead) in enumerate(tried)]
    return F.filter(F.array(*found), lambda m: m["base"].isNotNull())


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, source, target (a file's path): distinct edges, self-imports dropped.

    The file that a base means, the first of those that are tried, is worked out once for all imports; each import then is one
    row of an equi join (SET-4). Sizes of exploded rows are estimated far too low, so neither side may be broadcast by them.
    """
    is_py = F.col("lang") == "py"
    base = F.when(is_py, python_base(F.col("source"), F.col("target"))).otherwise(js_base(F.col("source"), F.col("target")))
    asked = imports.select("repository_id", "source", F.when(is_py, "py").otherwise("js").alias("_lang"), base.alias("base")).where("base is not null")
    asked = asked.select("repository_id", "source", "base", F.when(paths.suffix(paths.basename(F.col("base"))) != "", "exact").otherwise(F.col("_lang")).alias("how"))
    meant = files.select("repository_id", "path", F.explode(meanings(F.col("path"))).alias("_m")).select("repository_id", "path", "_m.*")
    meant = meant.groupBy("repository_id", "how", "base").agg(F.min_by("path", "k").alias("target"))
    return asked.join(meant.hint("merge"), ["repository_id", "how", "base"]).where("target <> source").select("repository_id", "source", "target").distinct()
