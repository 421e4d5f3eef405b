"""Expressions against plain Python."""

import os
import posixpath
import random
import re
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions import paths, rowwise, text, vector

NAMES = [".py", "a.py", ".eslintrc.js", "foo.", "Dockerfile", "a.tar.gz", "X.PY", "userService.ts", "__init__.py"]


def test_suffix_and_stem(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", paths.suffix(F.col("n")).alias("s"), paths.stem(F.col("n")).alias("t"))
    for r in df.collect():
        assert r["s"] == PurePosixPath(r["n"]).suffix
        if not r["n"].endswith("."):
            assert r["t"] == PurePosixPath(r["n"]).stem


@pytest.mark.parametrize(("path", "module", "service"), [("backend/app/main.py", "backend", False), ("frontend/src/App.tsx", "frontend", False), ("main.py", "main", False), ("backend/app/services/repository_service.py", "backend", True), ("src/user/UserService.ts", "src", True), ("services/x.py", "services", True), ("src/services.py", "src", True), ("a/service/b.py", "a", False)])
def test_module_and_service(spark, path, module, service):
    r = spark.createDataFrame([(path,)], "p string").select(paths.module(F.col("p")).alias("m"), paths.is_service(F.col("p")).alias("s")).first()
    assert (r["m"], r["s"]) == (module, service)


def test_normalised_matches_posixpath(spark):
    rng = random.Random(1)
    made = ["/".join(rng.choice(["a", "b", "..", ".", "", "c.d"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    for r in spark.createDataFrame([(m,) for m in made], "p string").select("p", paths.normalised(F.col("p")).alias("n")).collect():
        depth = 0
        out = False
        for part in r["p"].split("/"):
            depth += -1 if part == ".." else part not in ("", ".")
            out |= depth < 0
        want = posixpath.normpath("/root/" + r["p"])[len("/root/") :] if not out else None
        assert r["n"] == want, r["p"]


def test_lines_match_splitlines(spark):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab\n\r\v\f\x1c\x1d\x1e\x85   ") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["a\r\nb\r\n"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, t string").select("i", text.lines(F.col("t")).alias("l"))
    for r in df.collect():
        assert r["l"] == made[r["i"]].splitlines()


def test_strip_and_last_word(spark):
    made = ["  a b\t", " x y ", "one", "q?\n"]
    df = spark.createDataFrame([(m,) for m in made], "t string").select("t", text.strip(F.col("t")).alias("s"), text.last_word(F.col("t")).alias("w"))
    for r in df.collect():
        assert r["s"] == r["t"].strip()
        assert r["w"] == r["t"].split()[-1]


def test_js_imports_match_re(spark):
    pattern = re.compile(r"(?:(?:import|export)\s+.*?\s+from\s+|require\()[\"']([^\"']+)[\"']")
    made = ["import a from './a'", "import {\n b } from './b'", "export * from \"x\"\nconst c=require('./c')", "import d from './d'", "import './s'", "// import e from './e'", "import f  from './f'", "import('./g')"]
    df = spark.createDataFrame([(m,) for m in made], "t string").select("t", text.js_imports(F.col("t")).alias("j"))
    for r in df.collect():
        assert r["j"] == pattern.findall(r["t"])


def test_names_word(spark):
    rows = [("uses of backend here", "backend", True), ("backends", "backend", False), ("BACKEND?", "backend", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("the @app thing", "@app", False)]
    for r in spark.createDataFrame(rows, "t string, w string, want boolean").select("want", text.names_word(F.col("t"), F.col("w")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_strict_utf8(spark):
    rows = [(b"ok\r\nx",), (b"\xff",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(text.strict_utf8(F.col("b"))).collect()]
    assert got == ["ok\nx", None, None]


def test_cosine(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=16).tolist() for _ in range(20)] + [[0.0] * 16, None]
    q = v[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v array<double>").select("i", vector.cosine(F.col("v"), vector.literal(q)).alias("a"), vector.scorer(q)("v").alias("b"))
    for r in df.collect():
        if v[r["i"]] is None:
            assert r["a"] is None and r["b"] is None
            continue
        n = np.linalg.norm(v[r["i"]]) * np.linalg.norm(q)
        want = float(np.dot(v[r["i"]], q) / n) if n else 0.0
        assert abs(r["a"] - want) < 1e-12 and abs(r["b"] - want) < 1e-12


def test_cosine_of_unequal_sizes_fails(spark):
    with pytest.raises(Exception, match="differ in size"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(vector.cosine(F.col("v"), vector.literal([1.0, 2.0]))).collect()


def test_python_imports():
    assert rowwise.python_imports("import a.b, c as d\nfrom . import x\nfrom ..m import y\ndef f():\n    import z\n") == ["a.b", "c", ".", "..m", "z"]
    for bad in ("def (", "﻿import a", "a\0b", None):
        assert rowwise.python_imports(bad) == []


def test_manifests():
    assert rowwise.package_keys('{"dependencies": {"a": 1}, "devDependencies": {"b": 1, "a": 2}}') == ["a", "b"]
    assert rowwise.package_keys("{") is None and rowwise.package_keys("[]") is None and rowwise.package_keys(None) is None
    assert rowwise.pyproject_facts('[project]\ndependencies = ["FastAPI"]\n[build-system]\nbuild-backend="setuptools.build_meta"') == ("fastapi", "setuptools.build_meta")
    assert rowwise.pyproject_facts("[[[") == ("", "") and rowwise.pyproject_facts(None) == ("", "")


@pytest.mark.parametrize(("reply", "ok"), [('{"answer":"a","confidence":"x","sources":[],"graph_context_used":true}', True), ('```json\n{"answer":"a","confidence":"x","sources":["f"],"graph_context_used":"no"}\n```', True), ('```\n{"answer":"a","confidence":"x","sources":[],"graph_context_used":1}\n```', True), ('{"answer":"a","confidence":"x","sources":[],"graph_context_used":false} tail', True), ('lead {"answer":"a"}', False), ("[1]", False), ('{"answer":"a","confidence":"x","sources":"f","graph_context_used":true}', False), ('{"answer":1,"confidence":"x","sources":[],"graph_context_used":true}', False), ("", False), (None, False), ('{"answer":"a","confidence":"x","sources":[],"graph_context_used":true,"more":1}', True)])
def test_parse_answer(reply, ok):
    answer, wrong = rowwise.parse_answer(reply)
    assert (answer is not None) == ok and (wrong is None) == ok


def test_parse_summary():
    good = '{"executive_summary":"s","main_technologies":[],"architecture_observations":["x"],"notable_directories":[],"next_steps":[]}'
    assert rowwise.parse_summary(good)[1] is None
    assert rowwise.parse_summary(good + " tail")[0] is None
    assert rowwise.parse_summary('{"executive_summary":"s"}')[0] is None


def test_repository_key(spark):
    rows = [("https://x.y/Owner/Repo.git/", "repo-repo"), ("https://x.y/a.git.b", "repo-a.b")]
    for r in spark.createDataFrame(rows, "u string, want string").select("want", paths.repository_key(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_ignored_sets_differ():
    assert ".pytest_cache" in paths.IGNORED_METADATA and ".pytest_cache" not in paths.IGNORED_CHUNKS
    assert "coverage" in paths.IGNORED_CHUNKS and "coverage" not in paths.IGNORED_METADATA
    assert os.path.basename("x") == "x"
