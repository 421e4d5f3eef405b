"""Registered queries of the engine's own operators, over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import env_bool
from ..functions import paths, text, udfs, vector
from ..operators import chunking, embedding, graph, imports, metadata, prompts, retrieval, routing
from . import fixtures as fx
from . import indexed
from .store import latest, new_repositories

Query = Callable[[SparkSession, str], DataFrame]
MODULE = "Brand#13"


# ---------------------------------------------------------------- chunking, retrieval, prompts


def _chunks(size: int, overlap: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = fx.table(spark, d, "documents").select("doc_id", "text")
        return chunking.chunk_lines(docs, "text", size, overlap)

    return run


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(10, 2)(spark, d)
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(fx.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(fx.table(spark, d, "embeddings"), _query_vector(spark, d), 10, ["vec_id"], digits=6)


def vector_topk_numpy(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(fx.table(spark, d, "embeddings"), _query_vector(spark, d), 10, ["vec_id"], digits=6, numpy=True)


def vector_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Each row whose id is divisible by 50, at any table size, against all rows."""
    e = fx.table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k_per_query(e, q, 2, digits=6)


def zero_norm_guard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of all embeddings, and of a zero row, to one of them."""
    e = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    zero = e.where("vec_id = 0").select(F.lit(-1).cast("long").alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(0).cast("float")).alias("embedding"))
    return e.unionByName(zero).select("vec_id", F.round(vector.cosine(F.col("embedding"), vector.literal(_query_vector(spark, d))), 6).alias("similarity"))


def context_concat(spark: SparkSession, d: str) -> DataFrame:
    """A context of each document's chunks, all documents, at the operators' own limits."""
    x = chunking.chunk_lines(fx.table(spark, d, "documents").select("doc_id", "text"), "text", 100, 20)
    return prompts.context(x.withColumn("file_path", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), ["doc_id"], rank="chunk_index")


def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, embedded, the two nearest to a question, as a prompt's context."""
    x = embedding.embed(chunking.chunk_lines(fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")))
    q = embedding.HashingEmbedder().encode([fx.QUESTION])[0]
    best = retrieval.top_k(x, q, 2, digits=9, numpy=True).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "file_path", "chunk_index")))
    return prompts.context(x.join(F.broadcast(best), ["file_path", "chunk_index"]).withColumn("question_id", F.lit(1)), ["question_id"])


# ---------------------------------------------------------------- graph reads


def _g(f: Callable[[graph.Graph], DataFrame]) -> Query:
    return lambda spark, d: f(fx.part_graph(spark, d))


def _path(spark: SparkSession, d: str) -> str:
    return fx.part_files(spark, d).where("path like '%/7.py'").first()["path"]


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """All customers, met by all customers under keys 50 higher: some are kept, most replaced, some are new."""
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return graph.upsert(c, c.withColumns({"c_custkey": F.col("c_custkey") + 50, "c_acctbal": F.col("c_acctbal") + 1}), ["c_custkey"])


def existing_edges(spark: SparkSession, d: str) -> DataFrame:
    g = fx.part_graph(spark, d)
    return graph.existing(g.imports, g.files.where("module <> 'Brand#11'"), "path").select("source", "target")


# ---------------------------------------------------------------- files, imports, manifests, questions


def path_facts(spark: SparkSession, d: str) -> DataFrame:
    p = fx.rows(spark, fx.PATHS, "path string").withColumn("name", paths.basename(F.col("path"))).withColumn("dir_parts", F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1))
    return p.select("path", "name", paths.suffix(F.col("name")).alias("suffix"), paths.stem(F.col("name")).alias("stem"), paths.module(F.col("path")).alias("module"), paths.is_service(F.col("path")).alias("is_service"), paths.for_chunks(F.col("name"), F.col("dir_parts")).alias("for_chunks"), paths.for_graph(F.col("name"), F.col("dir_parts")).alias("for_graph"))


def url_keys(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", paths.repository_key(F.col("url")).alias("repository_key"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))


def js_import_extract(spark: SparkSession, d: str) -> DataFrame:
    return fx.rows(spark, fx.JS_LINES, "line int, code string").select("line", F.explode(text.js_imports(F.col("code"))).alias("target"))


def _source_files(spark: SparkSession) -> DataFrame:
    return fx.rows(spark, fx.SOURCES, "path string, code string").select(F.lit("r1").alias("repository_id"), "path", F.col("code").cast("binary").alias("content"))


def import_extract(spark: SparkSession, d: str) -> DataFrame:
    return imports.extract(_source_files(spark)).select("source", "lang", "target")


def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    f = _source_files(spark)
    return imports.resolve(imports.extract(f), graph.file_nodes(f)).select("source", "target")


def import_resolve_priority(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a TypeScript or JavaScript file or a folder with an index, by its key; each imports the next five."""
    p = fx.table(spark, d, "part").select("p_partkey")
    files = p.select(F.lit("r").alias("repository_id"), F.explode(F.filter(F.array(*(F.when(F.col("p_partkey") % m == 0, F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(s))) for m, s in fx.KINDS)), lambda x: x.isNotNull())).alias("path"))
    asked = p.select(F.lit("r").alias("repository_id"), F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("source"), F.lit("js").alias("lang"), F.explode(F.array(*(F.concat(F.lit("./"), (F.col("p_partkey") + k).cast("string")) for k in range(1, 6)))).alias("target"))
    return imports.resolve(asked, files).select("source", "target")


def technology_rules(spark: SparkSession, d: str) -> DataFrame:
    return metadata.technologies(fx.rows(spark, fx.MANIFESTS, "repository_id string, path string, text string"))


def keyword_route(spark: SparkSession, d: str) -> DataFrame:
    q = fx.rows(spark, fx.QUESTIONS, "question_id int, question string")
    return q.select("question_id", routing.wants_graph(F.col("question")).alias("wants_graph"), routing.route(F.col("question")).alias("route"))


def direct_answers(spark: SparkSession, d: str) -> DataFrame:
    q = fx.rows(spark, fx.QUESTIONS, "question_id int, question string").withColumn("repository_id", F.lit(fx.REPO))
    return routing.direct_answers(q, fx.part_graph(spark, d)).select("question_id", "route", "answer")


def question_limits(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "conversations").select("conv_id", "turn", routing.acceptable(F.col("text")).alias("accepted"))


def url_limits(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", paths.valid_url(F.col("url")).alias("accepted"))


def latest_report(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest(o, ["o_custkey"], "o_orderdate", "o_orderkey")


def repo_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All customers and suppliers are offered, all customers are known."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    offered = c.unionByName(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))
    return new_repositories(c, offered, "name")


def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    x = fx.rows(spark, fx.REPLIES, "reply_id int, reply string").withColumn("p", udfs.parse_answer("reply"))
    return x.select("reply_id", "p.result.answer", "p.result.confidence", "p.result.graph_context_used", "p.error")


def prompt_json(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", udfs.ask_prompt("text", "role").alias("prompt"))


def prompt_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the prompts finds in them."""
    x = prompt_json(spark, d)
    shape = [F.get_json_object("prompt", f"$.required_json_shape.{k}").isNotNull() for k in prompts.SHAPE]
    return x.select("conv_id", "turn", F.get_json_object("prompt", "$.question").alias("question"), F.get_json_object("prompt", "$.retrieved_code").alias("retrieved"), reduce(and_, shape).alias("shaped"), F.substring("prompt", 1, 15).alias("begins"), F.col("prompt").rlike("^[\\x00-\\x7F]*$").alias("ascii"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each document to a question."""
    x = embedding.embed(fx.table(spark, d, "documents").select("doc_id", "text"), "text")
    q = embedding.HashingEmbedder().encode([fx.QUESTION])[0]
    return x.select("doc_id", F.size("embedding").alias("dims"), F.round(vector.cosine(F.col("embedding"), vector.literal(q)), 6).alias("similarity"))


def settings_parse(spark: SparkSession, d: str) -> DataFrame:
    """How each flag of the environment is read, absent ones too."""
    return spark.createDataFrame([(raw, env_bool({} if raw is None else {"X": raw}, "X", True)) for raw in fx.FLAGS], "raw string, flag boolean")


QUERIES: dict[str, Query] = {
    "chunk_lines_100_20": _chunks(100, 20), "chunk_lines_10_2": _chunks(10, 2), "chunk_counts": chunk_counts,
    "vector_topk": vector_topk, "vector_topk_numpy": vector_topk_numpy, "vector_topk_per_query": vector_topk_per_query, "zero_norm_guard": zero_norm_guard,
    "context_concat": context_concat, "retrieval_context": retrieval_context,
    "graph_stats": _g(lambda g: graph.stats(g).drop("repository_id")), "graph_file_count": _g(graph.file_count), "graph_module_count": _g(graph.module_count), "graph_modules": _g(graph.modules), "graph_file_paths": _g(graph.file_paths),
    "graph_files_in_module": _g(lambda g: graph.files_in_module(g, MODULE)), "graph_module_dependencies": _g(lambda g: graph.module_dependencies(g, MODULE)),
    "graph_imported_files": _g(graph.imported_files), "graph_module_uses": _g(graph.used_modules), "graph_all_module_uses": _g(lambda g: graph.used_modules(g, None)), "graph_services": _g(lambda g: graph.services(graph.Graph(g.files.withColumn("is_service", F.col("path").contains("STANDARD")), g.imports, g.uses))),
    "graph_central_files": _g(graph.central_files), "graph_context_central": _g(lambda g: graph.context(g)["central_files"]),
    "graph_imports_of": lambda s, d: graph.imports_of(fx.part_graph(s, d), _path(s, d)), "graph_importers_of": lambda s, d: graph.importers_of(fx.part_graph(s, d), _path(s, d)),
    "graph_existing_edges": existing_edges, "graph_upsert": upsert,
    "path_facts": path_facts, "url_keys": url_keys, "page_links": page_links, "js_import_extract": js_import_extract, "import_extract": import_extract, "import_resolve": import_resolve, "import_resolve_priority": import_resolve_priority,
    "technology_rules": technology_rules, "keyword_route": keyword_route, "direct_answers": direct_answers, "question_limits": question_limits,
    "latest_report": latest_report, "repo_upsert": repo_upsert, "answer_parse": answer_parse, "prompt_json": prompt_json,
    "prompt_fields": prompt_fields, "embed_documents": embed_documents, "settings_parse": settings_parse, "url_limits": url_limits, **indexed.QUERIES,
}


# ---------------------------------------------------------------- the same in SQL


_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_FILES = f"files AS (SELECT {fx.PATH.replace('p_partkey', 'CAST(p_partkey AS VARCHAR)')} AS path, p_partkey, CAST(p_partkey AS VARCHAR) || '.py' AS name, p_brand AS module FROM part)"
_GRAPH = f"""WITH {_FILES},
li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
pairs AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM li x JOIN li y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey),
imports AS (SELECT f.path AS source, t.path AS target, f.module AS sm, t.module AS tm FROM pairs JOIN files f ON f.p_partkey = a JOIN files t ON t.p_partkey = b),
uses AS (SELECT DISTINCT sm AS source, tm AS target FROM imports WHERE sm <> tm)
"""


_IGN_M, _IGN_C = (", ".join(f"'{x}'" for x in s) for s in (paths.IGNORED_METADATA, paths.IGNORED_CHUNKS))
_RULES = fx.values(metadata.RULES)
_ROUTE = """CASE WHEN contains(q, 'how many files') THEN 'file_count' WHEN contains(q, 'how many modules') THEN 'module_count' WHEN contains(q, 'list modules') OR contains(q, 'what modules') THEN 'module_list'
 WHEN contains(q, 'files in module') OR contains(q, 'list files in') THEN 'files_in_module' WHEN contains(q, 'module') AND (contains(q, 'use') OR contains(q, 'depend')) THEN 'module_uses'
 WHEN contains(q, 'central') OR contains(q, 'imported the most') THEN 'central' ELSE 'llm' END"""
_CENTRAL = "SELECT target AS file, count(*) AS imports FROM imports GROUP BY target ORDER BY imports DESC, file LIMIT {}"

_STATS = "SELECT (SELECT count(*) FROM files) AS file_nodes, (SELECT count(DISTINCT module) FROM files) AS module_nodes, (SELECT count(*) FROM files WHERE contains(name, 'service') OR contains('/' || lower(path), '/services/')) AS service_nodes, (SELECT count(*) FROM imports) AS file_import_relationships, (SELECT count(*) FROM uses) AS module_use_relationships"

SQL: dict[str, str] = {
    "chunk_lines_100_20": fx.chunk_sql(100, 20),
    "chunk_lines_10_2": fx.chunk_sql(10, 2),
    "chunk_counts": f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({fx.chunk_sql(10, 2)}) GROUP BY doc_id",
    "vector_topk": f"SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 10",
    "vector_topk_numpy": f"SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 10",
    "vector_topk_per_query": f"SELECT query_id, vec_id, similarity, CAST(row_number() OVER w AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 2",
    "graph_stats": _GRAPH + _STATS,
    "graph_file_count": "SELECT count(*) AS files FROM part",
    "graph_module_count": "SELECT count(DISTINCT p_brand) AS modules FROM part",
    "graph_file_paths": f"WITH {_FILES} SELECT path FROM files",
    "graph_modules": "SELECT DISTINCT p_brand AS name FROM part",
    "graph_files_in_module": f"WITH {_FILES} SELECT name FROM files WHERE module = '{MODULE}'",
    "graph_module_dependencies": _GRAPH + f"SELECT target AS name FROM uses WHERE source = '{MODULE}'",
    "graph_imported_files": _GRAPH + "SELECT source, target FROM imports ORDER BY source, target LIMIT 50",
    "graph_module_uses": _GRAPH + "SELECT source, target FROM uses ORDER BY source, target LIMIT 50",
    "graph_all_module_uses": _GRAPH + "SELECT source, target FROM uses",
    "graph_services": f"WITH {_FILES} SELECT path AS service, module FROM files WHERE contains(path, 'STANDARD') ORDER BY service LIMIT 50",
    "graph_central_files": _GRAPH + _CENTRAL.format(10),
    "graph_context_central": _GRAPH + f"SELECT file, imports AS import_count FROM ({_CENTRAL.format(20)})",
    "graph_imports_of": _GRAPH + "SELECT target AS file FROM imports WHERE source LIKE '%/7.py'",
    "graph_importers_of": _GRAPH + "SELECT source AS file FROM imports WHERE target LIKE '%/7.py'",
    "graph_existing_edges": _GRAPH + "SELECT source, target FROM imports WHERE sm <> 'Brand#11' AND tm <> 'Brand#11'",
    "path_facts": f"""
WITH p AS (SELECT path, string_split(path, '/') AS s, string_split(path, '/')[-1] AS name FROM (VALUES {fx.values(fx.PATHS)}) t(path)),
q AS (SELECT *, s[:-2] AS dirs, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM p),
r AS (SELECT *, name[:length(name) - length(suffix)] AS stem FROM q)
SELECT path, name, suffix, stem, CASE WHEN len(s) = 1 THEN stem ELSE s[1] END AS module, contains(lower(stem), 'service') OR contains('/' || lower(path), '/services/') AS is_service,
 NOT list_has_any(dirs, [{_IGN_C}]) AND name NOT IN ({', '.join(f"'{x}'" for x in paths.LOCKFILES)}) AND (lower(suffix) IN ({', '.join(f"'{x}'" for x in paths.CHUNK_SUFFIXES)}) OR name = 'Dockerfile') AS for_chunks,
 NOT list_has_any(dirs, [{_IGN_M}]) AND suffix IN ({', '.join(f"'{x}'" for x in paths.GRAPH_SUFFIXES)}) AS for_graph FROM r""",
    "url_keys": "SELECT page_id, 'repo-' || lower(replace(string_split(rtrim(url, '/'), '/')[-1], '.git', '')) AS repository_key FROM pages",
    "page_links": "SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)",
    "js_import_extract": rf"""SELECT line, unnest(regexp_extract_all(code, '(?:(?:import|export)\s+.*?\s+from\s+|require\()["'']([^"'']+)["'']', 1)) AS target FROM (VALUES {fx.values(fx.JS_LINES)}) t(line, code)""",
    "technology_rules": f"""
WITH m AS (SELECT * FROM (VALUES {fx.values(fx.MANIFESTS)}) t(repository_id, source, body)), r AS (SELECT * FROM (VALUES {_RULES}) t(source, k, name, category)),
j AS (SELECT repository_id, source, list_concat(coalesce(json_keys(body, '$.dependencies'), []), coalesce(json_keys(body, '$.devDependencies'), [])) AS ks FROM m WHERE source = 'package.json' AND json_valid(body))
SELECT repository_id, 'Node.js' AS name, 'runtime' AS category, source FROM j
UNION SELECT repository_id, 'Python', 'language', source FROM m WHERE source <> 'package.json'
UNION SELECT repository_id, name, category, source FROM j JOIN r USING (source) WHERE list_contains(ks, k)
UNION SELECT repository_id, name, category, source FROM m JOIN r USING (source) WHERE source = 'requirements.txt' AND contains(lower(body), k)
UNION SELECT repository_id, name, category, source FROM m JOIN r USING (source) WHERE source = 'pyproject.toml' AND contains(lower(regexp_extract(body, 'dependencies = \\[(.*)\\]', 1)), k)
UNION SELECT repository_id, 'Poetry', 'packaging', source FROM m WHERE source = 'pyproject.toml' AND contains(regexp_extract(body, 'build-backend = "(.*)"', 1), 'poetry')""",
    "keyword_route": f"SELECT question_id, len(list_filter([{', '.join(repr(k) for k in routing.KEYWORDS)}], lambda k: contains(q, k))) > 0 AS wants_graph, {_ROUTE} AS route FROM (SELECT question_id, lower(question) AS q FROM (VALUES {fx.values(fx.QUESTIONS)}) t(question_id, question))",
    "direct_answers": _GRAPH + f""",
q AS (SELECT question_id, q, {_ROUTE} AS r FROM (SELECT question_id, lower(question) AS q FROM (VALUES {fx.values(fx.QUESTIONS)}) t(question_id, question))),
u AS (SELECT question_id, min(module) AS m FROM q JOIN (SELECT DISTINCT module FROM files) ON r = 'module_uses' AND regexp_matches(q, '(?i)\\b' || module || '\\b') GROUP BY question_id),
a AS (SELECT question_id, r, CASE r
  WHEN 'file_count' THEN 'The repository contains ' || (SELECT count(*) FROM files) || ' files.'
  WHEN 'module_count' THEN 'The repository contains ' || (SELECT count(DISTINCT module) FROM files) || ' modules.'
  WHEN 'module_list' THEN (SELECT string_agg(module, ', ' ORDER BY module) FROM (SELECT DISTINCT module FROM files))
  WHEN 'files_in_module' THEN (SELECT 'Module ''' || string_split(q, ' ')[-1] || ''' contains ' || count(*) || ' files:' || chr(10) || chr(10) || coalesce(string_agg('- ' || name, chr(10) ORDER BY name), '') FROM files WHERE module = string_split(q, ' ')[-1])
  WHEN 'module_uses' THEN (SELECT 'Module ''' || m || ''' uses ' || count(*) || ' module(s):' || chr(10) || chr(10) || string_agg('- ' || target, chr(10) ORDER BY target) FROM uses WHERE source = m GROUP BY m)
  WHEN 'central' THEN (SELECT string_agg(file || ' (' || imports || ' imports)', chr(10) ORDER BY imports DESC, file) FROM ({_CENTRAL.format(10)})) END AS answer
 FROM q LEFT JOIN u USING (question_id))
SELECT question_id, CASE WHEN answer IS NULL THEN 'llm' ELSE r END AS route, answer FROM a""",
    "question_limits": "SELECT conv_id, turn, length(text) BETWEEN 3 AND 2000 AS accepted FROM conversations",
    "latest_report": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "zero_norm_guard": f"SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q UNION ALL SELECT -1, 0.0",
    "context_concat": f"SELECT doc_id, CASE WHEN length(w) > 12000 THEN w[:12000] || chr(10) || '[...retrieved context truncated...]' ELSE w END AS context FROM (SELECT doc_id, string_agg('File: doc' || doc_id || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index) AS w FROM ({fx.chunk_sql(100, 20)}) GROUP BY doc_id)",
    "import_resolve_priority": f"""WITH files AS ({' UNION ALL '.join(f"SELECT p_partkey AS k, {i} AS o, 'm/' || p_partkey || '{x}' AS path FROM part WHERE p_partkey % {m} = 0" for i, (m, x) in enumerate(fx.KINDS))}),
t AS (SELECT p_partkey, unnest(range(p_partkey + 1, p_partkey + 6)) AS k FROM part)
SELECT DISTINCT 'm/' || p_partkey || '.ts' AS source, arg_min(path, o) AS target FROM t JOIN files USING (k) GROUP BY p_partkey, k""",
    "import_extract": f"SELECT * FROM (VALUES {fx.values(fx.EXTRACTED)}) t(source, lang, target)",
    "import_resolve": f"SELECT * FROM (VALUES {fx.values(fx.RESOLVED)}) t(source, target)",
    "answer_parse": f"SELECT * FROM (VALUES {fx.PARSED}) t(reply_id, answer, confidence, graph_context_used, error)",
    "prompt_fields": """SELECT conv_id, turn, text AS question, role AS retrieved, true AS shaped, '{' || chr(10) || '  "question":' AS begins, true AS ascii FROM conversations""",
    "settings_parse": f"SELECT raw, coalesce(lower(trim(raw)) IN ('1', 'true', 'yes', 'on'), true) AS flag FROM (VALUES {', '.join('(NULL)' if x is None else f"('{x}')" for x in fx.FLAGS)}) t(raw)",
    "url_limits": r"SELECT page_id, coalesce(regexp_full_match(url, '(?i)https?://[^\s/?#]+([/?#]\S*)?') AND length(url) <= 2048, false) AS accepted FROM pages",
    "embed_documents": f"WITH t AS (SELECT doc_id AS k, text FROM documents), {fx.EMBED} SELECT k AS doc_id, 384 AS dims, round(similarity, 6) AS similarity FROM sim",
    "retrieval_context": f"""WITH c AS ({fx.chunk_sql(100, 20)}), t AS (SELECT struct_pack(f := CAST(doc_id AS VARCHAR), i := chunk_index, content := content) AS k, content AS text FROM c), {fx.EMBED},
best AS (SELECT k, row_number() OVER (ORDER BY round(similarity, 9) DESC, k.f, k.i) AS r FROM sim QUALIFY r <= 2), w AS (SELECT string_agg('File: ' || k.f || chr(10) || k.content, chr(10) || chr(10) ORDER BY r) AS w FROM best)
SELECT 1 AS question_id, CASE WHEN length(w) > 12000 THEN w[:12000] || chr(10) || '[...retrieved context truncated...]' ELSE w END AS context FROM w""",
    **indexed.SQL,
    "store_graph": _GRAPH + _STATS,
    "graph_upsert": "SELECT c_custkey + 50 AS c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey + 50 FROM customer)",
    "repo_upsert": "SELECT s_suppkey AS key, s_name AS name FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)",
}
