"""Question routing and direct answers (RTE-1..3, FLT-10, FLT-14, JOIN-14), for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import DIRECT_LIMIT, Graph

KEYWORDS = ("architecture", "call", "calls", "central", "depend", "dependencies", "dependency", "file", "files", "flow", "graph", "import", "imports", "module", "modules", "service", "services", "use", "uses")
LENGTHS = (3, 2000)
SOURCES = {"file_count": "File nodes", "module_count": "Module nodes", "module_list": "Module nodes", "files_in_module": "Module to File edges", "module_uses": "Module USES edges", "central": "IMPORTS edges"}


def wants_graph(question: Column) -> Column:
    return text.any_keyword(question, KEYWORDS)


def acceptable(question: Column) -> Column:
    """The length that a question may have (FLT-11)."""
    return F.length(question).between(*LENGTHS)


def route(question: Column) -> Column:
    """The first rule that fits the lower-cased question, else `llm`; rules are in this order."""
    q = F.lower(question)
    has = lambda *parts: F.lit(False) if not parts else q.contains(parts[0]) | has(*parts[1:])
    return (
        F.when(has("how many files"), "file_count")
        .when(has("how many modules"), "module_count")
        .when(has("list modules", "what modules"), "module_list")
        .when(has("files in module", "list files in"), "files_in_module")
        .when(has("module") & has("use", "depend"), "module_uses")
        .when(has("central", "imported the most"), "central")
        .otherwise("llm")
    )


def direct_answers(questions: DataFrame, g: Graph) -> DataFrame:
    """question_id, repository_id, question, route, answer, confidence, sources, graph_context_used.

    questions: question_id, repository_id, question. A question whose rule finds nothing to say (no module named, no
    imports) falls through to route `llm` with a null answer, as do all that no rule fits. Answers that list things are
    made once for each repository or module that is asked for, and joined.
    """
    q = questions.select("question_id", "repository_id", "question", route(F.col("question")).alias("_r")).withColumn("_low", F.lower("question"))
    asked = q.select("repository_id").distinct()
    files = g.files.join(F.broadcast(asked) if _few(asked) else asked, "repository_id", "left_semi")
    bullets = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: F.concat(F.lit("- "), x)), "\n")
    per = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("_files"), F.array_join(F.array_sort(F.collect_set("module")), ", ").alias("_list"), F.count_distinct("module").alias("_mods"))
    x = q.join(per, "repository_id", "left").fillna(0, ["_files", "_mods"])
    # (d) files in the module that the last word names, case and punctuation included
    x = x.withColumn("_m", F.when(F.col("_r") == "files_in_module", text.last_word(F.col("_low"))))
    of_asked = files.join(x.select("repository_id", F.col("_m").alias("module")).where("module is not null").distinct(), ["repository_id", "module"], "left_semi")
    inside = of_asked.groupBy("repository_id", F.col("module").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), bullets("name").alias("_names"))
    x = x.join(inside, ["repository_id", "_m"], "left")
    # (e) the first module by name that the question names
    e = q.where(F.col("_r") == "module_uses").select("question_id", "repository_id", "_low")
    named = e.join(files.select("repository_id", "module").distinct(), "repository_id").where(text.names_word(F.col("_low"), F.col("module"))).groupBy("question_id", "repository_id").agg(F.min("module").alias("_u"))
    used = g.uses.groupBy("repository_id", F.col("source").alias("_u")).agg(F.count(F.lit(1)).alias("_un"), bullets("target").alias("_ul"))
    x = x.join(named, ["question_id", "repository_id"], "left").join(used, ["repository_id", "_u"], "left")
    # (f) central files
    degree = g.imports.groupBy("repository_id", "target").agg(F.count("source").alias("n"))
    # Each task keeps its own first few of a repository before the shuffle (a window group limit).
    first = Window.partitionBy("repository_id").orderBy(F.desc("n"), "target")
    best = degree.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= DIRECT_LIMIT).groupBy("repository_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("target").alias("t")))), 1, DIRECT_LIMIT).alias("b"))
    best = best.select("repository_id", F.array_join(F.transform("b", lambda s: F.concat(s["t"], F.lit(" ("), (-s["k"]).cast("string"), F.lit(" imports)"))), "\n").alias("_central"))
    x = x.join(best, "repository_id", "left")
    r = F.col("_r")
    answer = (
        F.when(r == "file_count", F.format_string("The repository contains %d files.", "_files"))
        .when(r == "module_count", F.format_string("The repository contains %d modules.", "_mods"))
        .when(r == "module_list", F.coalesce("_list", F.lit("")))
        .when(r == "files_in_module", F.concat(F.lit("Module '"), "_m", F.lit("' contains "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" files:\n\n"), F.coalesce("_names", F.lit(""))))
        .when((r == "module_uses") & F.col("_u").isNotNull() & F.col("_un").isNull(), F.concat(F.lit("Module '"), "_u", F.lit("' does not use any other modules.")))
        .when((r == "module_uses") & F.col("_u").isNotNull(), F.concat(F.lit("Module '"), "_u", F.lit("' uses "), F.col("_un").cast("string"), F.lit(" module(s):\n\n"), "_ul"))
        .when(r == "central", F.col("_central"))
    )
    source = F.coalesce(*(F.when(r == k, F.array(F.lit(v))) for k, v in SOURCES.items()))
    y = x.select("question_id", "repository_id", "question", r.alias("_r"), answer.alias("answer"), source.alias("_s"))
    ok = F.col("answer").isNotNull()
    return y.select("question_id", "repository_id", "question", F.when(ok, F.col("_r")).otherwise("llm").alias("route"), "answer", F.when(ok, F.lit("high")).alias("confidence"), F.when(ok, F.col("_s")).alias("sources"), ok.alias("graph_context_used"))


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most
