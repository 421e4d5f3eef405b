"""Registered queries over a stored index, which the engine makes of source trees written from `documents`.

All documents become files of two repositories, by the parity of their ids: Python and JavaScript files that import each
other, Markdown, and files in directories that all, some or no branch ignores. Every 23rd file isn't valid UTF-8. The trees
are written by tasks into the folder that driver and executors share, indexed by service.index_trees(), and read from the
store by all queries of an application. The folders go when Python ends.
"""

from __future__ import annotations

import atexit
import io
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import SedgeError, SummaryError
from ..functions import paths
from ..operators import chunking, generators, graph, metadata
from ..session import bound_batches, register
from ..sources import git
from . import fixtures as fx
from . import http, service
from .store import Store

Query = Callable[[SparkSession, str], DataFrame]

#: The same SQL in Spark and DuckDB.
_PATH = """CASE WHEN doc_id % 29 = 3 THEN concat('node_modules/n', doc_id, '.js') WHEN doc_id % 29 = 5 THEN concat('.pytest_cache/c', doc_id, '.md')
 WHEN doc_id % 29 = 7 THEN concat('coverage/v', doc_id, '.ts') WHEN doc_id % 29 = 11 THEN concat('.github/g', doc_id, '.yml') WHEN doc_id % 29 = 13 THEN concat('src/_private/t', doc_id, '.txt')
 ELSE concat(lang, '/p', doc_id % 7, '/', CASE WHEN doc_id % 11 = 0 THEN 'UserService' ELSE 'f' END, doc_id, CASE doc_id % 5 WHEN 2 THEN '.ts' WHEN 3 THEN '.js' WHEN 4 THEN '.md' ELSE '.py' END) END"""
_CODE = """CASE WHEN path LIKE '%.py' THEN concat('from .f', doc_id + 14, ' import x', chr(10), 'import ', lang2, '.p', (doc_id + 10) % 7, '.f', doc_id + 10, chr(10), 'import os', chr(10), '# ', flat)
 WHEN path LIKE '%.ts' OR path LIKE '%.js' THEN concat('import a from ', chr(39), './f', doc_id + 14, chr(39), chr(10), 'const b = require("../p', (doc_id + 10) % 7, '/f', doc_id + 10, '.ts")', chr(10), 'export * from ', chr(39), 'react', chr(39), chr(10), '// ', flat)
 ELSE text END"""
_REPO = "CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END"
_CONTROL = r"[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}]"
_INVALID = "doc_id % 23 = 0"
#: Files of both repositories besides.
_EXTRA = {
    "package.json": '{"dependencies": {"react": "1", "express": "4"}, "devDependencies": {"typescript": "5"}}\n', "requirements.txt": "FastAPI\npytest==8\n", "pyproject.toml": '[project]\ndependencies = ["flask>=3"]\n[build-system]\nbuild-backend = "setuptools.build_meta"\n',
    "package-lock.json": "{}\n", "Dockerfile": "FROM x\nRUN y\n", "empty.py": "", "empty_dir/": "",
}
#: technology, category, manifest; by category, technology and manifest.
_TECHNOLOGIES = (("Express", "backend framework", "package.json"), ("FastAPI", "backend framework", "requirements.txt"), ("Flask", "backend framework", "pyproject.toml"), ("React", "frontend library", "package.json"), ("Python", "language", "pyproject.toml"), ("Python", "language", "requirements.txt"), ("TypeScript", "language", "package.json"), ("Setuptools", "packaging", "pyproject.toml"), ("Node.js", "runtime", "package.json"), ("Pytest", "testing", "requirements.txt"))
_URL = "https://example.org/{}.git"
_STORES: dict[tuple[str, str], Store] = {}


def files(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, repo, path, code, content (code's bytes, one in front that no UTF-8 has for some)."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"))
    ahead = docs.select((F.col("doc_id") - 10).alias("doc_id"), F.col("lang").alias("lang2"))
    x = docs.withColumn("path", F.expr(_PATH)).join(ahead, "doc_id", "left").fillna("none", ["lang2"]).withColumn("flat", F.regexp_replace("text", _CONTROL, " "))
    x = x.select("doc_id", F.expr(_REPO).alias("repo"), "path", F.expr(_CODE).alias("code"))
    return x.withColumn("content", F.when(F.expr(_INVALID), F.concat(F.unhex(F.lit("FF")), F.col("code").cast("binary"))).otherwise(F.col("code").cast("binary")))


def write_trees(spark: SparkSession, d: str, root: str) -> dict[str, str]:
    """Folders by url."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, path, content in zip(b["repo"], b["path"], b["content"], strict=True):
                full = f"{root}/{repo}/{path}"
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    bound_batches(spark)
    files(spark, d).select("repo", "path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    for repo in "ab":
        for path, code in _EXTRA.items():
            full = f"{root}/{repo}/{path}"
            os.makedirs(os.path.dirname(full), exist_ok=True)
            if not path.endswith("/"):
                with open(full, "w") as f:
                    f.write(code)
    return {_URL.format(r): f"{root}/{r}" for r in "ab"}


def _folder(spark: SparkSession) -> str:
    folder = tempfile.mkdtemp(prefix="sedge-index-", dir=service.shared_folder(spark))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def trees(spark: SparkSession, d: str) -> DataFrame:
    """repo and the rows of both trees."""
    root = _store(spark, d).root.removeprefix("file://").removesuffix("/store")
    register(spark)
    one = lambda r: spark.read.format("repotree").option("path", f"{root}/{r}").option("repository_id", r).load()
    return one("a").unionByName(one("b")).withColumnRenamed("repository_id", "repo")


def _store(spark: SparkSession, d: str) -> Store:
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        folder = _folder(spark)
        store = Store(spark, f"file://{folder}/store")
        service.index_trees(spark, store, write_trees(spark, d, folder))
        _STORES[key] = store
    return _STORES[key]


def _named(store: Store, df: DataFrame) -> DataFrame:
    """df with repo (a or b) for its repository_id."""
    known = store.repositories().select(F.col("id").alias("repository_id"), F.regexp_extract("repo_url", "/([ab])[.]git$", 1).alias("repo"))
    return df.join(known, "repository_id").drop("repository_id")


def _of(f: Callable[[Store], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        store = _store(spark, d)
        return _named(store, f(store))

    return run


def _graph(f: Callable[[graph.Graph], DataFrame]) -> Query:
    return _of(lambda store: f(store.graph()))


# ---------------------------------------------------------------- the scan


def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    return trees(spark, d).select("repo", "path", "kind", F.array_join("dir_parts", "/").alias("parent"), "name", "size")


def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    return metadata.counts(trees(spark, d).withColumnRenamed("repo", "repository_id")).withColumnRenamed("repository_id", "repo")


def tree_decode(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files that are not valid UTF-8, read with what is wrong left out."""
    t = trees(spark, d).withColumnRenamed("repo", "repository_id").where(~F.is_valid_utf8(F.col("content").cast("string")))
    return chunking.chunk_files(t).groupBy(F.col("repository_id").alias("repo"), "file_path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


# ---------------------------------------------------------------- what was stored


def index_chunks(store: Store) -> DataFrame:
    return store.table("chunks").select("repository_id", "file_path", "chunk_index", "start_line", "end_line", "content", F.size("embedding").alias("dims"))


def index_chunk_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each chunk of one repository in the order in which the store gives them."""
    store = _store(spark, d)
    x = store.chunks(store.repository_by_url(_URL.format("a"))["id"]).select("file_path", "chunk_index")
    return x.withColumn("_at", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("chunk_index", "_at").alias("first"), F.max_by("chunk_index", "_at").alias("last"), F.count(F.lit(1)).alias("n"))


def index_reports(store: Store) -> DataFrame:
    r, s = store.reports(), F.col("summary")
    return r.select(
        "repository_id", "status", "file_count", "directory_count", F.array_join("ignored_directories", ",").alias("ignored"), s["executive_summary"].alias("executive_summary"), F.array_join(s["main_technologies"], ",").alias("main_technologies"),
        F.array_join(s["architecture_observations"], " ").alias("observations"), F.array_join(s["notable_directories"], ",").alias("notable"), F.array_join(s["next_steps"], " ").alias("next_steps"), F.col("token_usage.total_tokens").alias("tokens"),
    )


def index_technologies(store: Store) -> DataFrame:
    return store.reports().select("repository_id", F.posexplode("technologies").alias("pos", "t")).select("repository_id", "pos", "t.name", "t.category", "t.source")


def index_directory_json(store: Store) -> DataFrame:
    """The nested structure as a reader finds it: entries in all, those at the top in order, the first directory's first child."""
    j = F.col("directory_structure")
    each = lambda k: F.size(F.regexp_extract_all(j, F.lit(f'"kind": "{k}"'), 0))
    return store.reports().select("repository_id", each("file").alias("files"), each("directory").alias("directories"), F.array_join(F.from_json(F.get_json_object(j, "$[*].name"), "array<string>"), ",").alias("top"), F.get_json_object(j, "$[0].children[0].path").alias("first_child"))


def _is_new(store: Store) -> DataFrame:
    """Ids and times that the store gave (ID-1, DT-1)."""
    uuid4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    fresh = F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds(F.col("created_at").cast("timestamp"))) < 86_400
    return store.repositories().select(F.col("id").alias("repository_id"), F.col("id").rlike(uuid4).alias("uuid4"), fresh.alias("fresh"), (F.col("created_at") <= F.col("updated_at")).alias("ordered"))


def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By url, then by id, then the latest report; a known url offered again gets the id that it has."""
    store, rows = _store(spark, d), []
    for r in "ab":
        own = store.repository_by_url(_URL.format(r))
        report = store.latest_report(own["id"])
        again = store.get_or_create([_URL.format(r)])[_URL.format(r)]
        rows.append((store.repository(own["id"])["repo_url"], report["status"], report["file_count"], again == own["id"], store.repository_by_url("https://example.org/none") is None))
    return spark.createDataFrame(rows, "repo_url string, status string, file_count int, same boolean, unknown boolean")


def _chunk_rows(spark: SparkSession, d: str, repo: str, version: str) -> DataFrame:
    x = fx.table(spark, d, "documents").where(F.expr(_REPO) == repo).select(F.lit(repo).alias("repository_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.concat(F.lit(version), F.coalesce("text", F.lit(""))).alias("text"))
    return chunking.chunk_lines(x, "text", 10, 2).withColumn("embedding", F.array().cast("array<double>"))


def _store_steps(spark: SparkSession, d: str) -> Store:
    """Both repositories written; one written anew; a run for the other that is never committed."""
    store = Store(spark, f"file://{_folder(spark)}/store")
    store.replace("r1", {"chunks": _chunk_rows(spark, d, "a", "1:").unionByName(_chunk_rows(spark, d, "b", "1:"))})
    store.commit("r1", ["a", "b"])
    store.replace("r2", {"chunks": _chunk_rows(spark, d, "b", "2:")})
    store.commit("r2", ["b"])
    store.replace("r3", {"chunks": _chunk_rows(spark, d, "a", "3:")})
    return store


def _versions(store: Store) -> DataFrame:
    x = store.table("chunks").withColumn("version", F.when(F.col("chunk_index") == 0, F.substring("content", 1, 2)))
    return x.groupBy(F.col("repository_id").alias("repo")).agg(F.max("version").alias("newest"), F.min("version").alias("oldest"), F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


def store_replace(spark: SparkSession, d: str) -> DataFrame:
    return _versions(_store_steps(spark, d))


def store_delete(spark: SparkSession, d: str) -> DataFrame:
    store = _store_steps(spark, d)
    store.delete("chunks", "b")
    return _versions(store)


def store_graph(spark: SparkSession, d: str) -> DataFrame:
    """The counts that writing a graph gives, of the graph of the parts."""
    store = Store(spark, f"file://{_folder(spark)}/store")
    return store.store_graph("r", fx.part_graph(spark, d)).drop("repository_id")


def store_vacuum(spark: SparkSession, d: str) -> DataFrame:
    """Folders that go, what can be read before and after."""
    store = _store_steps(spark, d)
    before, gone, again = _versions(store).collect(), store.vacuum(), store.vacuum()
    return spark.createDataFrame(before, _versions(store).schema).exceptAll(_versions(store)).agg(F.count(F.lit(1)).alias("lost")).select(F.lit(gone).alias("gone"), F.lit(again).alias("again"), "lost")


def store_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports are appended; the latest of each repository counts."""
    store = Store(spark, f"file://{_folder(spark)}/store")
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repository_id"), F.lit("analyzed").alias("status"), F.col("c_nationkey").alias("file_count"))
    for part in (c, c.withColumn("file_count", F.col("file_count") + 100)):
        blank = {f.name: F.lit(None).cast(f.dataType) for f in metadata.REPORT_FIELDS if f.name not in part.columns}
        store.append_reports(part.withColumns(blank))
    newest = store.latest_reports().select("repository_id", "status", "file_count")
    return newest.join(store.reports().groupBy("repository_id").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("id").alias("ids")), "repository_id")


# ---------------------------------------------------------------- questions

ASKED = ("How many files are there?", "How many modules?", "list modules", "which files are imported the most?", "list files in en", "Which module does module coverage depend on?", "who wrote this")
REPLY = '{"answer": "nobody", "confidence": "low", "sources": ["x", "y"], "graph_context_used": "no"} that is all'


def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    own, rows = store.repository_by_url(_URL.format("a"))["id"], []
    for q in ASKED:
        told = service.ask(spark, store, own, q, generators.Scripted([REPLY]))
        a = told["answer"]
        rows.append((told["question"], a["answer"], a["confidence"], ",".join(a["sources"]), a["graph_context_used"], told["token_usage"]["total_tokens"]))
    return spark.createDataFrame(rows, "question string, answer string, confidence string, sources string, graph_context_used boolean, tokens int")


def ask_prompt(spark: SparkSession, d: str) -> DataFrame:
    """What the generator is asked for a question that no rule answers: the question, and the two nearest chunks."""
    store, generator = _store(spark, d), generators.Scripted([REPLY])
    service.ask(spark, store, store.repository_by_url(_URL.format("a"))["id"], fx.QUESTION, generator)
    system, user = generator.prompts[0].removeprefix("SYSTEM PROMPT:\n").split("\n\nUSER PROMPT:\n", 1)
    x = spark.createDataFrame([(bool(system), user)], "system boolean, user string")
    return x.select("system", F.get_json_object("user", "$.question").alias("question"), F.get_json_object("user", "$.retrieved_code").alias("retrieved"))


def api_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests to the routes, as a client sees them: status, and what is told."""
    store = _store(spark, d)
    own = store.repository_by_url(_URL.format("a"))["id"]
    api, rows = http.Api(spark, store, Settings(app_name="x"), generators.Scripted([REPLY])), []
    ask = lambda **body: ("POST", "/api/v1/ask", json.dumps(body).encode())
    asked = {
        "health": ("GET", "/api/v1/health", b""), "count": ask(repository_id=own, question=ASKED[0]), "generated": ask(repository_id=own, question=ASKED[6]), "short": ask(repository_id=own, question="?"), "unknown": ask(repository_id="none", question=ASKED[0]),
        "no_json": ("POST", "/api/v1/ask", b"{"), "no_url": ("POST", "/api/v1/repository", b'{"repo_url": "ftp://x"}'), "no_route": ("GET", "/api/v2/health", b""), "no_method": ("GET", "/api/v1/ask", b""),
    }
    for name, request in asked.items():
        status, body = api.dispatch(*request)
        told = json.loads(body)
        rows.append((name, status, told.get("app_name") or told.get("answer", {}).get("answer")))
    return spark.createDataFrame(rows, "request string, status int, told string")


def summary_prompt(spark: SparkSession, d: str) -> DataFrame:
    """What a summary is asked from, and what comes of the reply; a reply without its shape is an error."""
    store = _store(spark, d)
    own = store.repository_by_url(_URL.format("a"))["id"]
    generator = generators.Scripted([json.dumps({"executive_summary": "s", "main_technologies": ["t"], "architecture_observations": [], "notable_directories": [], "next_steps": ["n", "m"]}), "{}"])
    told = service.summarize(store, own, generator)
    try:
        wrong = service.summarize(store, own, generator)
    except SummaryError:
        wrong = None
    asked = json.loads(generator.prompts[0].split("\n\nUSER PROMPT:\n", 1)[1])
    top = asked["top_level_structure"]
    github = next(e for e in top if e["name"] == ".github")
    row = (asked["repo_url"], asked["file_count"], asked["directory_count"], len(asked["technologies"]), ",".join(e["name"] for e in top), ",".join(e["name"] for e in github["children"]), told["executive_summary"], len(told["next_steps"]), wrong is None)
    return spark.createDataFrame([row], "repo_url string, file_count int, directory_count int, technologies int, top string, children string, summary string, steps int, shapeless boolean")


def generated(spark: SparkSession, d: str) -> DataFrame:
    """What the generators say when servers answer, don't, or answer wrongly."""
    s = Settings(ollama_url="http://one", ollama_others=("http://two",), openai_key="k")

    def server(reply: bytes, down: tuple[str, ...] = ()) -> Callable:
        def opener(request: object, timeout: float) -> io.BytesIO:
            if any(request.full_url.startswith(u) for u in down):
                raise OSError("down")
            return io.BytesIO(reply)

        return opener

    def completion(text: str | None) -> SimpleNamespace:
        done = SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=text))])
        return SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=lambda **_: done)))

    fine = b'{"response": "fine"}'
    cases: dict[str, Callable[[], str]] = {
        "ollama": lambda: generators.Ollama(s, server(fine)).generate("p"), "ollama_other": lambda: generators.Ollama(s, server(fine, ("http://one",))).generate("p"), "ollama_none": lambda: generators.Ollama(s, server(fine, ("http://",))).generate("p"),
        "ollama_no_json": lambda: generators.Ollama(s, server(b"<")).generate("p"), "ollama_blank": lambda: generators.Ollama(s, server(b'{"response": " "}')).generate("p"), "blank_prompt": lambda: generators.Ollama(s, server(fine)).generate(" \n"),
        "openai": lambda: generators.OpenAI(s, completion("well")).generate("p"), "openai_none": lambda: generators.OpenAI(s, completion(None)).generate("p"), "openai_no_key": lambda: generators.OpenAI(Settings(), completion("well")).generate("p"),
        "made_ollama": lambda: type(generators.create(Settings.from_env({"LLM_PROVIDER": "ollama"}))).__name__, "made_openai": lambda: type(generators.create(Settings.from_env({"LLM_PROVIDER": " OpenAI "}))).__name__, "made_other": lambda: str(generators.create(Settings.from_env({"LLM_PROVIDER": "x"}))),
    }
    rows = []
    for name, run in cases.items():
        try:
            rows.append((name, run(), None))
        except (SedgeError, ValueError) as e:
            rows.append((name, None, type(e).__name__))
    return spark.createDataFrame(rows, "request string, reply string, error string")


def clone_scan(spark: SparkSession, d: str) -> DataFrame:
    """A repository of two commits, cloned without its history, and scanned."""
    folder = _folder(spark)
    origin = f"{folder}/origin"
    for n, text in enumerate(("one\n", "one\ntwo\n")):
        os.makedirs(f"{origin}/src", exist_ok=True)
        with open(f"{origin}/src/a.py", "w") as f:
            f.write(text)
        for words in ([["init", "-q"]] if n == 0 else []) + [["add", "-A"], ["-c", "user.name=x", "-c", "user.email=x@localhost", "commit", "-q", "-m", str(n)]]:
            subprocess.run(["git", "-C", origin, *words], check=True, capture_output=True)
    git.clone(f"file://{origin}", f"{folder}/clone")
    commits = subprocess.run(["git", "-C", f"{folder}/clone", "rev-list", "--count", "HEAD"], check=True, capture_output=True, text=True).stdout
    register(spark)
    x = spark.read.format("repotree").option("path", f"{folder}/clone").load()
    return x.select("path", "kind", "size", F.lit(int(commits)).alias("commits"))


QUERIES: dict[str, Query] = {
    "summary_prompt": summary_prompt, "generated": generated, "clone_scan": clone_scan, "api_answers": api_answers, "tree_scan": tree_scan, "tree_counts": tree_counts, "tree_decode": tree_decode,
    "index_chunks": _of(index_chunks), "index_chunk_counts": _of(lambda s: s.counts()), "index_chunk_order": index_chunk_order, "index_reports": _of(index_reports), "index_technologies": _of(index_technologies), "index_directory_json": _of(index_directory_json),
    "index_graph_files": _graph(lambda g: g.files), "index_graph_imports": _graph(lambda g: g.imports), "index_graph_uses": _graph(lambda g: g.uses), "index_graph_stats": _graph(graph.stats),
    "store_ids": _of(_is_new), "store_lookup": store_lookup, "store_replace": store_replace, "store_delete": store_delete, "store_graph": store_graph, "store_vacuum": store_vacuum, "store_reports": store_reports, "ask_answers": ask_answers, "ask_prompt": ask_prompt,
}


# ---------------------------------------------------------------- the same in SQL


def _names(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_lit = lambda v: "'" + v.replace("'", "''") + "'"
_ROWS = ", ".join(f"('{r}', {_lit(p)}, {_lit(c)})" for r in "ab" for p, c in _EXTRA.items() if not p.endswith("/"))
#: f (repo, path, code, valid, s: segments, name, dirs, suffix): all files that stand in a tree.
_FILES = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'none') AS lang FROM documents),
p AS (SELECT d.*, {_PATH} AS path, coalesce((SELECT any_value(e.lang) FROM d e WHERE e.doc_id = d.doc_id + 10), 'none') AS lang2, regexp_replace(text, '{_CONTROL}', ' ', 'g') AS flat FROM d),
e AS (SELECT {_REPO} AS repo, path, {_CODE} AS code, NOT ({_INVALID}) AS valid FROM p UNION ALL SELECT repo, path, code, true FROM (VALUES {_ROWS}) t(repo, path, code)),
f AS (SELECT *, s[:-2] AS dirs, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM (SELECT *, string_split(path, '/') AS s, string_split(path, '/')[-1] AS name FROM e)),
dir AS (SELECT DISTINCT repo, dirs[:n] AS x FROM (SELECT repo, dirs, unnest(range(1, len(dirs) + 1)) AS n FROM f) UNION SELECT repo, ['empty_dir'] FROM (VALUES ('a'), ('b')) t(repo))"""
_SCANNED = f"NOT list_has_any({{}}, {_names(paths.IGNORED_ALWAYS)})"
_SEEN = f"NOT list_has_any({{}}, {_names(paths.IGNORED_METADATA)})"
_CHUNKED = f"""c AS (SELECT repo, path, struct_pack(repo := repo, path := path) AS k, code AS text, valid FROM f WHERE NOT list_has_any(dirs, {_names(paths.IGNORED_CHUNKS)}) AND name NOT IN ({_names(paths.LOCKFILES)[1:-1]}) AND (lower(suffix) IN ({_names(paths.CHUNK_SUFFIXES)[1:-1]}) OR name = 'Dockerfile')),
ch AS ({fx.chunk_sql(100, 20, "c", "k")})"""
#: gf: files of the graph; ge: import edges; gu: module edges.
_GRAPH = f"""
gf AS (SELECT repo, path, name, valid, suffix, array_to_string(dirs, '/') AS here, CASE WHEN len(s) = 1 THEN replace(name, suffix, '') ELSE s[1] END AS module, contains(lower(replace(name, suffix, '')), 'service') OR contains('/' || lower(path), '/services/') AS is_service, code FROM f WHERE {_SEEN.format("dirs")} AND suffix IN ({_names(paths.GRAPH_SUFFIXES)[1:-1]})),
py AS (SELECT repo, path, here, unnest(regexp_extract_all(code, '(?m)^(?:from|import) ([^ \\n]+)', 1)) AS t FROM gf WHERE valid AND suffix = '.py'),
js AS (SELECT repo, path, here, unnest(regexp_extract_all(code, '(?:(?:import|export)\\s+.*?\\s+from\\s+|require\\()["'']([^"'']+)["'']', 1)) AS t FROM gf WHERE valid AND suffix <> '.py'),
tries AS (SELECT repo, path, t, CASE WHEN t[1] = '.' THEN here || '/' || t[2:] ELSE replace(t, '.', '/') END || '.py' AS target, 0 AS o FROM py
 UNION ALL SELECT repo, path, t, CASE WHEN t[1:3] = '../' THEN array_to_string(string_split(here, '/')[:-2], '/') || t[3:] ELSE here || t[2:] END || x.x, x.o FROM js, (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4)) x(x, o) WHERE t[1] = '.'),
ge AS (SELECT DISTINCT repo, path AS source, target FROM (SELECT tries.repo, tries.path, t, arg_min(target, o) AS target FROM tries JOIN gf ON gf.repo = tries.repo AND gf.path = target GROUP BY ALL) WHERE path <> target),
gu AS (SELECT DISTINCT ge.repo, a.module AS source, b.module AS target FROM ge JOIN gf a ON a.repo = ge.repo AND a.path = source JOIN gf b ON b.repo = ge.repo AND b.path = ge.target WHERE a.module <> b.module)"""
_TOP = f"top AS (SELECT repo, x[1] AS name, 0 AS o FROM dir WHERE len(x) = 1 AND {_SEEN.format('x')} UNION ALL SELECT repo, name, 1 FROM f WHERE len(dirs) = 0)"
_COUNTS = f"SELECT repo, CAST((SELECT count(*) FROM f WHERE f.repo = r.repo AND {_SEEN.format('dirs')}) AS INTEGER) AS file_count, CAST((SELECT count(*) FROM dir WHERE dir.repo = r.repo AND {_SEEN.format('x')}) AS INTEGER) AS directory_count FROM (VALUES ('a'), ('b')) r(repo)"
_N_PY = "SELECT count(*) FROM gf WHERE repo = 'a'"
_VERSION = lambda repo, v: f"v{repo} AS (SELECT doc_id, '{v}:' || coalesce(text, '') AS text FROM documents WHERE {_REPO} = '{repo}')"
_VERSIONS = lambda repo, v: f"SELECT '{repo}' AS repo, '{v}:' AS newest, '{v}:' AS oldest, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({fx.chunk_sql(10, 2, f'v{repo}')}) HAVING count(*) > 0"

SQL: dict[str, str] = {
    "tree_scan": f"WITH {_FILES} SELECT repo, path, 'file' AS kind, array_to_string(dirs, '/') AS parent, name, CAST(strlen(code) + CASE WHEN valid THEN 0 ELSE 1 END AS BIGINT) AS size FROM f WHERE {_SCANNED.format('dirs')} UNION ALL SELECT repo, array_to_string(x, '/'), 'directory', array_to_string(x[:-2], '/'), x[-1], NULL FROM dir WHERE {_SCANNED.format('x')}",
    "tree_counts": f"WITH {_FILES} {_COUNTS}",
    "tree_decode": f"WITH {_FILES}, {_CHUNKED} SELECT k.repo AS repo, k.path AS file_path, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ch JOIN c USING (k) WHERE NOT c.valid GROUP BY ALL",
    "index_chunks": f"WITH {_FILES}, {_CHUNKED} SELECT k.repo AS repo, k.path AS file_path, chunk_index, start_line, end_line, content, 384 AS dims FROM ch",
    "index_chunk_counts": f"WITH {_FILES}, {_CHUNKED} SELECT k.repo AS repo, count(*) AS chunks FROM ch GROUP BY ALL",
    "index_chunk_order": f"WITH {_FILES}, {_CHUNKED} SELECT k.path AS file_path, CAST(0 AS INTEGER) AS first, CAST(count(*) - 1 AS INTEGER) AS last, count(*) AS n FROM ch WHERE k.repo = 'a' GROUP BY k.path",
    "index_reports": f"""WITH {_FILES}, {_TOP}, n AS ({_COUNTS}) SELECT repo, 'analyzed' AS status, file_count, directory_count, {_lit(','.join(sorted(paths.IGNORED_METADATA)))} AS ignored, 'This repository contains ' || file_count || ' files across ' || directory_count || ' directories.' AS executive_summary,
 {_lit(','.join(t[0] for t in _TECHNOLOGIES))} AS main_technologies, {_lit(' '.join(metadata.OBSERVATIONS))} AS observations, (SELECT array_to_string(list(name ORDER BY o, lower(name), name)[:5], ',') FROM top WHERE top.repo = n.repo) AS notable, {_lit(' '.join(metadata.NEXT_STEPS))} AS next_steps, 0 AS tokens FROM n""",
    "index_technologies": f"SELECT repo, pos, name, category, source FROM (VALUES ('a'), ('b')) r(repo), (VALUES {fx.values(tuple((i, *t) for i, t in enumerate(_TECHNOLOGIES)))}) t(pos, name, category, source)",
    "index_directory_json": f"""WITH {_FILES}, {_TOP}, n AS ({_COUNTS}) SELECT repo, file_count AS files, directory_count AS directories, (SELECT string_agg(name, ',' ORDER BY o, lower(name), name) FROM top WHERE top.repo = n.repo) AS top, (SELECT arg_min(path, lower(name)) FROM f WHERE f.repo = n.repo AND dirs = ['.github']) AS first_child FROM n""",
    "index_graph_files": f"WITH {_FILES}, {_GRAPH} SELECT repo, path, name, module, is_service FROM gf",
    "index_graph_imports": f"WITH {_FILES}, {_GRAPH} SELECT repo, source, target FROM ge",
    "index_graph_uses": f"WITH {_FILES}, {_GRAPH} SELECT repo, source, target FROM gu",
    "index_graph_stats": f"WITH {_FILES}, {_GRAPH} SELECT repo, count(*) AS file_nodes, count(DISTINCT module) AS module_nodes, count(*) FILTER (is_service) AS service_nodes, (SELECT count(*) FROM ge WHERE ge.repo = gf.repo) AS file_import_relationships, (SELECT count(*) FROM gu WHERE gu.repo = gf.repo) AS module_use_relationships FROM gf GROUP BY repo",
    "summary_prompt": f"""WITH {_FILES}, {_TOP}, n AS ({_COUNTS}) SELECT 'https://example.org/a.git' AS repo_url, file_count, directory_count, {len(_TECHNOLOGIES)} AS technologies, (SELECT array_to_string(list(name ORDER BY o, lower(name), name)[:30], ',') FROM top WHERE repo = 'a') AS top,
 (SELECT array_to_string(list(name ORDER BY lower(name), name)[:20], ',') FROM f WHERE repo = 'a' AND dirs = ['.github']) AS children, 's' AS summary, 2 AS steps, true AS shapeless FROM n WHERE repo = 'a'""",
    "generated": "SELECT * FROM (VALUES ('ollama', 'fine', NULL), ('ollama_other', 'fine', NULL), ('ollama_none', NULL, 'GeneratorError'), ('ollama_no_json', NULL, 'GeneratorError'), ('ollama_blank', NULL, 'GeneratorError'), ('blank_prompt', NULL, 'GeneratorError'), ('openai', 'well', NULL), ('openai_none', NULL, 'GeneratorError'), ('openai_no_key', NULL, 'GeneratorError'), ('made_ollama', 'Ollama', NULL), ('made_openai', 'OpenAI', NULL), ('made_other', NULL, 'ValueError')) t(request, reply, error)",
    "clone_scan": "SELECT * FROM (VALUES ('src', 'directory', NULL, 1), ('src/a.py', 'file', CAST(8 AS BIGINT), 1)) t(path, kind, size, commits)",
    "api_answers": f"""WITH {_FILES}, {_GRAPH} SELECT request, status, told FROM (VALUES ('health', 200, 'x'), ('generated', 200, 'nobody'), ('short', 422, NULL), ('unknown', 400, NULL), ('no_json', 422, NULL), ('no_url', 422, NULL), ('no_route', 404, NULL), ('no_method', 405, NULL)) t(request, status, told)
UNION ALL SELECT 'count', 200, 'The repository contains ' || count(*) || ' files.' FROM gf WHERE repo = 'a'""",
    "store_ids": "SELECT repo, true AS uuid4, true AS fresh, true AS ordered FROM (VALUES ('a'), ('b')) t(repo)",
    "store_lookup": f"WITH {_FILES}, n AS ({_COUNTS}) SELECT 'https://example.org/' || repo || '.git' AS repo_url, 'analyzed' AS status, file_count, true AS same, true AS unknown FROM n",
    "store_replace": f"WITH {_VERSION('a', 1)}, {_VERSION('b', 2)} {_VERSIONS('a', 1)} UNION ALL {_VERSIONS('b', 2)}",
    "store_delete": f"WITH {_VERSION('a', 1)} {_VERSIONS('a', 1)}",
    "store_vacuum": "SELECT 2 AS gone, 0 AS again, 0 AS lost",
    "store_reports": "SELECT CAST(c_custkey AS VARCHAR) AS repository_id, 'analyzed' AS status, CAST(c_nationkey + 100 AS INTEGER) AS file_count, 2 AS reports, 2 AS ids FROM customer",
    "ask_answers": f"""WITH {_FILES}, {_GRAPH}, g AS (SELECT * FROM gf WHERE repo = 'a')
SELECT {_lit(ASKED[0])} AS question, 'The repository contains ' || count(*) || ' files.' AS answer, 'high' AS confidence, 'File nodes' AS sources, true AS graph_context_used, 0 AS tokens FROM g
UNION ALL SELECT {_lit(ASKED[1])}, 'The repository contains ' || count(DISTINCT module) || ' modules.', 'high', 'Module nodes', true, 0 FROM g
UNION ALL SELECT {_lit(ASKED[2])}, string_agg(DISTINCT module, ', ' ORDER BY module), 'high', 'Module nodes', true, 0 FROM g
UNION ALL SELECT {_lit(ASKED[3])}, string_agg(target || ' (' || n || ' imports)', chr(10) ORDER BY n DESC, target), 'high', 'IMPORTS edges', true, 0 FROM (SELECT target, count(*) AS n FROM ge WHERE repo = 'a' GROUP BY target ORDER BY n DESC, target LIMIT 10)
UNION ALL SELECT {_lit(ASKED[4])}, 'Module ''en'' contains ' || count(*) || ' files:' || chr(10) || chr(10) || coalesce(string_agg('- ' || name, chr(10) ORDER BY name), ''), 'high', 'Module to File edges', true, 0 FROM g WHERE module = 'en'
UNION ALL SELECT {_lit(ASKED[5])}, 'Module ''coverage'' does not use any other modules.', 'high', 'Module USES edges', true, 0
UNION ALL SELECT {_lit(ASKED[6])}, 'nobody', 'low', 'x,y', false, 0""",
    "ask_prompt": f"""WITH {_FILES}, {_CHUNKED}, t AS (SELECT struct_pack(f := k.path, i := chunk_index, content := content) AS k, content AS text FROM ch WHERE k.repo = 'a'), {fx.EMBED},
best AS (SELECT k, row_number() OVER (ORDER BY round(similarity, 9) DESC, k.f, k.i) AS r FROM sim QUALIFY r <= 2), w AS (SELECT string_agg('File: ' || k.f || chr(10) || k.content, chr(10) || chr(10) ORDER BY r) AS w FROM best)
SELECT true AS system, {_lit(fx.QUESTION)} AS question, CASE WHEN length(w) > 12000 THEN w[:12000] || chr(10) || '[...retrieved context truncated...]' ELSE w END AS retrieved FROM w""",
}
