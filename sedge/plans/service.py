"""What users call: index_repository, index_trees, ask, health (API-1..4, DOM-10, OBS-1)."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..errors import AskError, GeneratorError, IndexingError, RequestError, SummaryError
from ..functions import paths, rowwise
from ..operators import chunking, embedding, generators, graph, metadata, prompts, retrieval, routing
from ..session import register
from ..sources import git
from .store import Store

log = logging.getLogger("sedge")


def index_trees(spark: SparkSession, store: Store, trees: dict[str, str], make: Callable[[], embedding.Embedder] = embedding.HashingEmbedder) -> dict[str, str]:
    """Index source trees (url -> folder) in one job; ids by url. The scan is written once and read by all branches."""
    register(spark)
    ids = store.get_or_create(list(trees))
    run = uuid.uuid4().hex
    roots = json.dumps([[ids[u], path] for u, path in trees.items()])
    scan = f"{store.root}/_scans/{run}"
    spark.read.format("repotree").option("roots", roots).load().write.parquet(scan)
    tree = spark.read.parquet(scan)
    g = graph.build(tree)
    chunks = embedding.embed(chunking.chunk_files(tree), make=make)
    store.replace(run, {"chunks": chunks})
    store.store_graph(run, g)
    store.append_reports(metadata.reports(tree))
    store.commit(run, [ids[u] for u in trees])
    p = spark._jvm.org.apache.hadoop.fs.Path(scan)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    log.info("indexed %d trees in run %s", len(trees), run)
    return ids


def shared_folder(spark: SparkSession) -> str | None:
    """Where executors can read a clone: spark.checkpoint.dir, if that is a mounted folder; else (None) only local runs can."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    root = re.sub("^file:(//)?(?=/)", "", root)
    if not root:
        return None
    if not root.startswith("/"):
        raise IndexingError("git clones into mounted folders only; clone first and give path.")
    os.makedirs(root, exist_ok=True)
    return root


def index_repository(spark: SparkSession, store: Store, url: str, path: str | None = None, make: Callable[[], embedding.Embedder] = embedding.HashingEmbedder) -> dict:
    """Index one repository from its url, or from a folder that holds it already; returns what a client is told."""
    if not re.fullmatch(paths.URL, url or "") or len(url) > paths.URL_CHARS:
        raise RequestError("repo_url must be an http or https URL of at most 2048 characters.")
    with tempfile.TemporaryDirectory(prefix="sedge-clone-", dir=shared_folder(spark)) as folder:
        if path is None:
            path = f"{folder}/repository"
            git.clone(url, path)
        try:
            repository_id = index_trees(spark, store, {url: path}, make)[url]
        except OSError as e:
            raise IndexingError(str(e)) from e
    report = store.latest_report(repository_id)
    stats = graph.stats(store.graph(repository_id)).first()
    zero = dict.fromkeys(("file_nodes", "module_nodes", "service_nodes", "file_import_relationships", "module_use_relationships"), 0)
    told = {k: stats[k] for k in zero} if stats else zero
    return {"repository_id": repository_id, "repo_url": url, "status": report["status"], "file_count": report["file_count"], "directory_count": report["directory_count"], "technologies": report["technologies"], "directory_structure": json.loads(report["directory_structure"] or "[]"), "summary": report["summary"], "token_usage": report["token_usage"], "graph": told}


def ask(spark: SparkSession, store: Store, repository_id: str, question: str, generator: generators.Generator | None = None, make: Callable[[], embedding.Embedder] = embedding.HashingEmbedder, k: int = retrieval.TOP_K) -> dict:
    """Answer one question: by a graph rule if one fits, else by a generator over the nearest chunks."""
    if not repository_id or not routing.LENGTHS[0] <= len(question) <= routing.LENGTHS[1]:
        raise RequestError("A question has 3 to 2000 characters and names a repository.")
    store.repository(repository_id)
    store.latest_report(repository_id)
    usage = {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
    asked = spark.createDataFrame([(0, repository_id, question)], schemas.QUESTIONS)
    direct = routing.direct_answers(asked, store.graph(repository_id)).first()
    if direct["route"] != "llm":
        answer = {c: direct[c] for c in ("answer", "confidence", "sources", "graph_context_used")}
        return {"repository_id": repository_id, "question": question, "answer": answer, "token_usage": usage}
    vector = make().encode([question])[0]
    best = retrieval.retrieve(store.table("chunks", repository_id), repository_id, vector, k).withColumn("g", F.lit(0))
    found = prompts.context(best, ["g"]).first()
    prompt = prompts.combined(prompts.ASK_SYSTEM, prompts.user_prompt(question, found["context"] if found else ""))
    try:
        reply = (generator or generators.create()).generate(prompt)
    except GeneratorError as e:
        raise AskError(str(e)) from e
    answer, wrong = rowwise.parse_answer(reply)
    if wrong:
        raise AskError(wrong)
    return {"repository_id": repository_id, "question": question, "answer": answer, "token_usage": usage}


def summarize(store: Store, repository_id: str, generator: generators.Generator | None = None) -> dict:
    """A generated summary of the latest report (DOM-10)."""
    report = store.latest_report(repository_id)
    prompt = prompts.combined(prompts.SUMMARY_SYSTEM, prompts.summary_prompt(store.repository(repository_id)["repo_url"], report, json.loads(report["directory_structure"] or "[]")))
    try:
        reply = (generator or generators.create()).generate(prompt)
    except GeneratorError as e:
        raise SummaryError(str(e)) from e
    summary, wrong = rowwise.parse_summary(reply)
    if wrong:
        raise SummaryError(wrong)
    return summary


def health(settings: Settings | None = None) -> dict:
    s = settings or Settings.from_env()
    return {"status": "ok", "app_name": s.app_name, "environment": s.environment, "version": s.version}
