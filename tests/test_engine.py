"""Trees, graphs, chunks, the store and questions, end to end."""

import io
import json
import os
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sedge import config, errors
from sedge.functions import vector
from sedge.operators import chunking, embedding, generators, graph, metadata, prompts, retrieval, routing
from sedge.plans import fixtures as fx
from sedge.plans import service
from sedge.plans.store import Store, latest
from sedge.sources import repotree

GOOD = '{"answer": "yes", "confidence": "low", "sources": ["backend/api.py"], "graph_context_used": false}'


def write(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full) or root, exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture(scope="session")
def tree_dir(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree") / "repo")
    os.makedirs(root)
    write(root, dict(fx.SOURCES))
    write(root, {
        "package.json": '{"dependencies": {"react": "1"}}', "requirements.txt": "flask-cors\n", "pyproject.toml": "[[", "sub/package.json": '{"dependencies": {"vue": "1"}}', "package-lock.json": "{}",
        "Dockerfile": "FROM x", "UPPER.MD": "# hi", "X.PY": "import main\n", "_x.py": "", ".hidden.py": "import main\n", ".github/w.yml": "on: x", "node_modules/m/i.js": "x", "coverage/c.py": "y = 1\n", ".pytest_cache/p.py": "z = 1\n",
        "bad.py": b"import main\n\xff", "bad.md": b"ab\xffcd\n", "nul.py": b"import main\0", "bom.py": "﻿import main\n", "name with#sign.md": "x", "long.md": "\n".join(map(str, range(250))), "empty/.keep": "", "crlf.py": b"import main\r\nx = 1\r\n",
    })
    os.symlink(root, os.path.join(root, "loop"))
    os.makedirs(os.path.join(root, "void"))
    return root


@pytest.fixture(scope="session")
def tree(spark, tree_dir):
    return spark.read.format("repotree").option("path", tree_dir).option("repository_id", "r").load().cache()


def test_scan_is_faithful(tree, tree_dir):
    got = {(r["path"], r["kind"]) for r in tree.select("path", "kind").collect()}
    want = set()
    for where, dirs, files in os.walk(tree_dir):
        dirs[:] = [d for d in dirs if d != "node_modules"]
        base = os.path.relpath(where, tree_dir)
        at = lambda n, base=base: n if base == "." else f"{base}/{n}"
        want |= {(at(d), "directory") for d in dirs} | {(at(f), "file") for f in files}
    assert got == want
    assert tree.where("path = 'empty/.keep'").first()["size"] == 0


def test_filter_on_kind_is_pushed(spark, tree_dir):
    df = spark.read.format("repotree").option("path", tree_dir).load().where("kind = 'directory'").select("path")
    assert {r["path"] for r in df.collect()} >= {"void", "loop", "backend"}


def test_counts(tree, tree_dir):
    files = dirs = 0
    for _, d, f in os.walk(tree_dir):
        d[:] = [x for x in d if x not in {"node_modules", ".pytest_cache"}]
        dirs += len(d)
        files += len(f)
    r = metadata.counts(tree).first()
    assert (r["file_count"], r["directory_count"]) == (files, dirs)


def test_tree_json(tree):
    top = json.loads(metadata.directory_json(tree).first()["directory_structure"])
    kinds = [e["kind"] for e in top]
    assert kinds == sorted(kinds) and "node_modules" not in {e["name"] for e in top}
    assert [e["name"].lower() for e in top if e["kind"] == "file"] == sorted(e["name"].lower() for e in top if e["kind"] == "file")
    deep = metadata.shortened({"name": "a", "path": "a", "kind": "directory", "children": [{"name": str(i), "path": str(i), "kind": "file", "children": []} for i in range(30)]})
    assert len(deep["children"]) == 20


def test_tree_json_in_blocks(spark, monkeypatch):
    """The text is what json.dumps gives of the nested lists, in whatever blocks it is joined; Python sees single rows."""
    paths = ["b/", "b/z.py", "b/Z.py", "b/c/", "b/c/\"q\".py", "ab/", "a/", "a/é/", "a/é/x", "A.py", "a.py", "a b.py", "a!"]
    rows = [("r", p.rstrip("/"), p.rstrip("/").split("/")[-1], p.rstrip("/").split("/")[:-1], "directory" if p.endswith("/") else "file") for p in paths]
    df = spark.createDataFrame(rows, "repository_id string, path string, name string, dir_parts array<string>, kind string")

    def at(above):
        own = sorted((r for r in rows if r[3] == above), key=lambda r: (r[4] == "file", r[2].lower(), r[2]))
        return [{"name": r[2], "path": r[1], "kind": r[4], "children": at([*above, r[2]])} for r in own]

    for block in (10_000, 3):
        monkeypatch.setattr(metadata, "BLOCK", block)
        assert metadata.directory_json(df).first()["directory_structure"] == json.dumps(at([]))


def test_scan_gives_bounded_batches(tmp_path, monkeypatch):
    write(str(tmp_path), {f"d/{i}.md": "x" * 100 for i in range(20)})
    monkeypatch.setattr(repotree, "BATCH_BYTES", 300)
    reader = repotree._Reader({"path": str(tmp_path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 21 and max(b.num_rows for b in batches) <= 4
    monkeypatch.setattr(repotree, "BATCH_ROWS", 2)
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_technologies(tree):
    got = {(r["name"], r["source"]) for r in metadata.technologies(metadata.manifests(tree)).collect()}
    assert got == {("Node.js", "package.json"), ("React", "package.json"), ("Python", "requirements.txt"), ("Flask", "requirements.txt"), ("Python", "pyproject.toml")}


def model_chunks(text, size, overlap):
    lines, out, k = text.splitlines(), [], 0
    while k * (size - overlap) < len(lines):
        a = k * (size - overlap)
        out.append((k, a + 1, min(a + size, len(lines)), "\n".join(lines[a : a + size])))
        k += 1
    return out


@pytest.mark.parametrize(("size", "overlap"), [(100, 20), (10, 2), (3, 0), (5, 4)])
def test_chunks_match_model(spark, size, overlap):
    texts = ["\n".join(f"l{i}" for i in range(n)) + tail for n in (0, 1, 2, 9, 10, 11, 79, 80, 81, 100, 101, 160, 161, 250) for tail in ("", "\n", "\r\n\n")]
    df = chunking.chunk_lines(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", size, overlap)
    got = {}
    for r in df.collect():
        got.setdefault(r["i"], []).append((r["chunk_index"], r["start_line"], r["end_line"], r["content"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == model_chunks(t, size, overlap)


def test_chunk_limits():
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunk_lines(None, size=5, overlap=5)


def test_chunk_files(tree):
    x = chunking.chunk_files(tree)
    by = {}
    for r in x.collect():
        by.setdefault(r["file_path"], []).append(r)
    assert len(by["long.md"]) == 4
    assert by["bad.md"][0]["content"] == "abcd"
    assert {"Dockerfile", "UPPER.MD", "X.PY", ".pytest_cache/p.py", ".github/w.yml", "name with#sign.md"} <= set(by)
    assert not {"package-lock.json", "coverage/c.py", "_x.py", "node_modules/m/i.js"} & set(by)


def test_graph(tree):
    g = graph.build(tree)
    files = {r["path"]: r for r in g.files.collect()}
    assert {"_x.py", ".hidden.py", "bad.py", "coverage/c.py", "backend/__init__.py"} & set(files) == {"_x.py", ".hidden.py", "bad.py", "coverage/c.py"}
    assert "X.PY" not in files and ".pytest_cache/p.py" not in files
    assert files["backend/services/user_service.py"]["is_service"] and files["main.py"]["module"] == "main"
    edges = {(r["source"], r["target"]) for r in g.imports.collect()}
    assert {(".hidden.py", "main.py"), ("crlf.py", "main.py"), ("backend/api.py", "backend/models.py"), ("backend/api.py", "backend/services/__init__.py"), ("backend/api.py", "backend/services/user_service.py"), ("backend/services/user_service.py", "backend/models.py"), ("frontend/src/App.tsx", "frontend/src/util.ts"), ("frontend/src/App.tsx", "frontend/lib/index.js"), ("frontend/src/App.tsx", "frontend/src/exact.js"), ("frontend/src/util.ts", "frontend/src/App.tsx")} == edges
    assert {(r["source"], r["target"]) for r in g.uses.collect()} == {(".hidden", "main"), ("crlf", "main")}
    s = graph.stats(g).first()
    assert (s["file_import_relationships"], s["module_use_relationships"]) == (len(edges), 2)
    c = graph.context(g)
    assert set(c) == {"imported_files", "module_uses", "services", "central_files"}
    assert c["central_files"].first().asDict() == {"file": "backend/models.py", "import_count": 2}
    assert [r["name"] for r in graph.files_in_module(g, "frontend").collect()] == sorted(["App.tsx", "index.js", "exact.js", "user.service.ts", "util.ts"])
    assert [r["name"] for r in graph.module_dependencies(g, "crlf").collect()] == ["main"]
    assert [r["file"] for r in graph.importers_of(g, "main.py").collect()] == [".hidden.py", "crlf.py"]
    assert [r["file"] for r in graph.imports_of(g, "frontend/src/util.ts").collect()] == ["frontend/src/App.tsx"]


def test_counts_of_nothing_are_zero(tree):
    g = graph.build(tree).of("nowhere")
    assert graph.file_count(g).first()["files"] == 0 and graph.module_count(g).first()["modules"] == 0


def test_top_k_plan_and_ties(spark):
    rows = [(f"f{i}", i, [1.0, 0.0]) for i in range(5)] + [("z", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "file_path string, chunk_index int, embedding array<double>")
    x = retrieval.top_k(df, [2.0, 0.0], 3)
    assert [r["file_path"] for r in x.collect()] == ["f0", "f1", "f2"]
    assert "TakeOrderedAndProject" in x._jdf.queryExecution().executedPlan().toString()
    last = retrieval.top_k(df, [2.0, 0.0], 6).collect()[-1]
    assert last["file_path"] == "z" and last["similarity"] == 0.0


def test_embedder_is_stable():
    e = embedding.HashingEmbedder(32)
    a, b = e.encode(["some Words here", ""])
    assert a.tolist() == e.encode(["some words here"])[0].tolist() and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(b)


def test_embedder_counts_in_parts():
    """Texts cut into small parts give the same vectors; memory doesn't grow with the texts."""
    texts = ["camelCase and someWords12 é漢x", "", "A" * 30 + "b" * 70 + "9" * 50, "é" * 90 + ".x"] * 20
    whole, parts = embedding.HashingEmbedder(), embedding.HashingEmbedder()
    parts.PART, parts.KEPT = 5, 300
    assert all((a == b).all() for a, b in zip(whole.encode(texts), parts.encode(texts), strict=True)) and parts.encode([]) == []
    tracemalloc.start()
    whole.encode(["ab cd " * 50_000] * 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_embed_and_score_in_slices(spark):
    rows = [(i, None if i % 3 == 0 else f"word{i} and {i}" if i % 3 == 1 else "") for i in range(40)]
    x = embedding.embed(spark.createDataFrame(rows, "i int, content string"), make=lambda: embedding.HashingEmbedder(8))
    got = {r["i"]: r for r in x.withColumn("s", vector.scorer([1.0] * 8)("embedding")).collect()}
    for i, text in rows:
        want = None if text is None else embedding.HashingEmbedder(8).encode([text])[0].tolist()
        assert got[i]["embedding"] == want and (got[i]["s"] is None) == (want is None)
        assert want is None or abs(got[i]["s"] - sum(want) / 8**0.5) < 1e-12


def test_context_is_cut(spark):
    df = spark.createDataFrame([(1, 2, "b", "y" * 50), (1, 1, "a", "x")], "q int, rank int, file_path string, content string")
    assert prompts.context(df, ["q"]).first()["context"] == "File: a\nx\n\nFile: b\n" + "y" * 50
    assert prompts.context(df, ["q"], most=10).first()["context"] == "File: a\nx\n" + prompts.CUT


QUESTIONS = [("How many files?", "file_count"), ("how many modules are there", "module_count"), ("list modules", "module_list"), ("what modules does x use", "module_list"), ("files in module backend", "files_in_module"), ("does module a depend on b", "module_uses"), ("central files", "central"), ("imported the most", "central"), ("because", "llm"), ("Module profile", "llm")]


def test_routes(spark):
    df = spark.createDataFrame(QUESTIONS, "q string, want string").select("want", routing.route(F.col("q")).alias("got"), routing.wants_graph(F.col("q")).alias("g"), "q")
    for r in df.collect():
        assert r["want"] == r["got"], r["q"]
        assert r["g"]  # `use` hits because


@pytest.fixture(scope="session")
def store(spark, tree_dir, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.told = service.index_repository(spark, s, "https://example.org/a/b", tree_dir)
    return s


def test_index_response(store):
    told = store.told
    assert told["status"] == "analyzed" and told["graph"]["file_import_relationships"] == 10
    assert told["summary"]["main_technologies"][:1] == ["Flask"] and len(told["summary"]["notable_directories"]) == 5
    assert told["token_usage"] == {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}


def test_indexing_again_replaces(spark, store, tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(root)
    write(root, {"a.py": "import b\n", "b.py": "x = 1\n"})
    first = service.index_repository(spark, store, "https://example.org/re", root)
    n = store.table("chunks", first["repository_id"]).count()
    os.remove(os.path.join(root, "a.py"))
    again = service.index_repository(spark, store, "https://example.org/re", root)
    assert again["repository_id"] == first["repository_id"]
    assert (n, store.table("chunks", first["repository_id"]).count()) == (2, 1)
    assert again["graph"]["file_import_relationships"] == 0
    assert store.reports().where(F.col("repository_id") == first["repository_id"]).count() == 2
    assert store.latest_report(first["repository_id"])["file_count"] == 1
    assert store.repositories().where("repo_url = 'https://example.org/re'").count() == 1
    assert store.repository_by_url("https://example.org/re")["id"] == first["repository_id"] and store.repository_by_url("x") is None


def test_uncommitted_runs_are_unseen(spark, store):
    df = spark.createDataFrame([("ghost", "a", "a", "a", False)], store.table("graph_files").schema)
    store.replace("never", {"graph_files": df})
    assert store.table("graph_files", "ghost").count() == 0 and store.table("graph_files").where("repository_id = 'ghost'").count() == 0
    store.delete("graph_files", "ghost")
    assert not os.path.exists(f"{store.root}/graph_files/repository_id=ghost")


def test_partition_pruning(store):
    plan = store.table("chunks", store.told["repository_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repository_id" in plan


def test_ask_direct(spark, store):
    rid = store.told["repository_id"]
    said = service.ask(spark, store, rid, "How many files are there?")
    assert said["answer"]["graph_context_used"] and said["answer"]["answer"].startswith("The repository contains")
    said = service.ask(spark, store, rid, "list files in frontend")["answer"]["answer"]
    assert said.startswith("Module 'frontend' contains 5 files:\n\n- App.tsx\n- exact.js")
    assert "contains 0 files" in service.ask(spark, store, rid, "list files in Frontend?")["answer"]["answer"]
    assert service.ask(spark, store, rid, "what does module CRLF depend on")["answer"]["answer"] == "Module 'crlf' uses 1 module(s):\n\n- main"
    assert "does not use any other" in service.ask(spark, store, rid, "which module does backend use")["answer"]["answer"]
    assert service.ask(spark, store, rid, "most central files")["answer"]["answer"].startswith("backend/models.py (2 imports)\nmain.py (2 imports)")


def test_ask_generator(spark, store):
    g = generators.Scripted([GOOD])
    said = service.ask(spark, store, store.told["repository_id"], "who wrote this thing", g)
    assert said["answer"]["answer"] == "yes" and not said["answer"]["graph_context_used"]
    assert g.prompts[0].startswith("SYSTEM PROMPT:\n") and json.loads(g.prompts[0].split("USER PROMPT:\n")[1])["retrieved_code"].startswith("File: ")


def test_ask_errors(spark, store):
    rid = store.told["repository_id"]
    with pytest.raises(errors.AskError, match="No such"):
        service.ask(spark, store, "nope", "who wrote it")
    with pytest.raises(errors.RequestError):
        service.ask(spark, store, rid, "hi")
    with pytest.raises(errors.RequestError):
        service.ask(spark, store, rid, "x" * 2001)
    with pytest.raises(errors.AskError, match="valid JSON"):
        service.ask(spark, store, rid, "who wrote it", generators.Scripted(["I think {}"]))
    with pytest.raises(errors.AskError, match="shape"):
        service.ask(spark, store, rid, "who wrote it", generators.Scripted(["[1]"]))
    with pytest.raises(errors.AskError, match="empty"):
        service.ask(spark, store, rid, "who wrote it", generators.Scripted([" "]))
    with pytest.raises(errors.RequestError):
        service.index_repository(spark, store, "ftp://x/y")


def test_summarize(store):
    good = '{"executive_summary":"s","main_technologies":[],"architecture_observations":[],"notable_directories":[],"next_steps":[]}'
    assert service.summarize(store, store.told["repository_id"], generators.Scripted([good]))["executive_summary"] == "s"
    with pytest.raises(errors.SummaryError):
        service.summarize(store, store.told["repository_id"], generators.Scripted(["no"]))


def test_settings_and_factory():
    s = config.Settings.from_env({"LLM_PROVIDER": " Ollama ", "OLLAMA_BASE_URL": "http://h:1/", "OLLAMA_MODEL": "m", "DEBUG": "off", "OPENAI_TEMPERATURE": "0.5"})
    made = generators.create(s)
    assert isinstance(made, generators.Ollama) and (made.base_url, made.model, s.debug, s.openai_temperature) == ("http://h:1", "m", False, 0.5)
    assert isinstance(generators.create(config.Settings.from_env({"LLM_PROVIDER": "openai", "OPENAI_API_KEY": "k"})), generators.OpenAI)
    with pytest.raises(ValueError, match="unknown"):
        generators.create(config.Settings(generator="other"))
    with pytest.raises(errors.GeneratorError, match="not set"):
        generators.OpenAI(config.Settings()).generate("x")
    assert service.health(s)["status"] == "ok"


def test_ollama_over_a_fake_server():
    calls = []

    def opener(request, timeout):
        calls.append((request.full_url, timeout))
        if "h:1" in request.full_url:
            raise OSError("down")
        return io.BytesIO(b'{"response": "fine"}')

    o = generators.Ollama(config.Settings(ollama_url="http://h:1"), opener)
    assert o.generate("p") == "fine"
    assert calls[0] == ("http://h:1/api/tags", 3.0) and calls[-1][1] == 180
    with pytest.raises(errors.GeneratorError, match="prompt is empty"):
        o.generate("  ")

    def dead(request, timeout):
        raise OSError("down")

    with pytest.raises(errors.GeneratorError, match="No model server"):
        generators.Ollama(config.Settings(), dead).generate("p")


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c")], "k int, at int, id string")
    assert {(r["k"], r["id"]) for r in latest(df, ["k"], "at", "id").collect()} == {(1, "b"), (2, "c")}
    new = spark.createDataFrame([(2, 9, "d"), (3, 9, "e")], "k int, at int, id string")
    assert {(r["k"], r["id"]) for r in graph.upsert(df.where("k = 2"), new, ["k"]).collect()} == {(2, "d"), (3, "e")}


def test_http(spark, store):
    """The routes over a socket."""
    import threading
    import urllib.error
    import urllib.request

    from sedge.plans import http

    server = http.serve(http.Api(spark, store), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}{http.PREFIX}"
    try:
        with urllib.request.urlopen(f"{base}/health", timeout=30) as r:
            assert r.status == 200 and json.loads(r.read())["status"] == "ok"
        body = json.dumps({"repository_id": store.told["repository_id"], "question": "how many files"}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{base}/ask", body, method="POST"), timeout=120) as r:
            assert "files" in json.loads(r.read())["answer"]["answer"]
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/none", timeout=30)
        assert e.value.code == 404
    finally:
        server.shutdown()
    assert json.loads(http.to_json(store.told))["technologies"] is not None


def test_two_jobs_add_a_url_at_once(spark, tmp_path):
    """Both rows are there, all readers take the same one."""
    from sedge import schemas
    from sedge.plans.store import Store, now

    s = Store(spark, str(tmp_path / "s"))
    at = now()
    for i in ("b", "a"):
        spark.createDataFrame([(i, "https://x/y", at, at)], schemas.REPOSITORIES).write.mode("append").parquet(f"{s.root}/repositories")
    assert s.get_or_create(["https://x/y", "https://x/z"])["https://x/y"] == "a"
    assert s.repository_by_url("https://x/y")["id"] == "a" and s.repositories().count() == 2


def test_stream_of_requests(spark, store, tmp_path):
    from sedge.streaming import requests

    root, folder = str(tmp_path / "r"), str(tmp_path / "in")
    os.makedirs(root)
    os.makedirs(folder)
    write(root, {"a.py": "x = 1\n"})
    with open(f"{folder}/1.json", "w") as f:
        f.write(json.dumps({"repo_url": "https://example.org/stream", "path": root}))
    q = requests.watch(spark, store, folder, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    row = store.repository_by_url("https://example.org/stream")
    assert store.table("graph_files", row["id"]).count() == 1


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q), 1"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=repo).returncode == 0
