"""Registered queries of the engine's own operators against their DuckDB SQL, and what the entry module offers."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sedge.operators import retrieval
from sedge.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    got = core.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_every_fiftieth_vector_is_a_query(spark):
    """Two answers for each id that 50 divides, of which there are more the more rows there are."""
    ids = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()]
    got = core.QUERIES["vector_topk_per_query"](spark, "/root/testdata/sf0.1").collect()
    assert len(ids) == 40 and sorted(r["query_id"] for r in got) == sorted(ids * 2)


def test_own_operators_take_whole_tables(spark, duck):
    """What the query over whole tables answers for: each row of its tables."""
    n = {t: duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("embeddings", "customer", "supplier")}
    got = {name: core.QUERIES[name](spark, DATA) for name in ("zero_norm_guard", "context_concat", "graph_upsert", "repo_upsert")}
    assert got["zero_norm_guard"].count() == n["embeddings"] + 1 and got["graph_upsert"].count() == n["customer"] + 50 and got["repo_upsert"].count() == n["supplier"]
    assert got["context_concat"].count() == duck.execute(f"SELECT count(DISTINCT doc_id) FROM ({core.SQL['chunk_lines_100_20']})").fetchone()[0]


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


def test_entry_without_the_training_data_operators():
    """The entry module imports, and offers the engine's own queries, where the llm folder and the pipeline are gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("sedge.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_top_k_and_edges_plan_as_wanted(spark):
    plan = lambda n: core.QUERIES[n](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("vector_topk") and "TakeOrderedAndProject" in plan("graph_central_files")
    assert "WindowGroupLimit" in plan("vector_topk_per_query")
    assert "Cartesian" not in "".join(plan(n) for n in ("graph_stats", "graph_module_uses", "import_resolve_priority"))


def test_imports_are_one_row_each_and_not_broadcast(spark):
    """Sizes of exploded rows are estimated far too low; by them millions of candidate paths had been sent to the driver."""
    from sedge.operators import imports

    plan = core.QUERIES["import_resolve_priority"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    paths = ["index.ts", "x.ts", "x/index.js", "x/__init__.py", "a/x.js", "a/x.jsx", "a/b.c.ts", "a/b.c", "a/.ts", "a/index.py", "__init__.py"]
    files = spark.createDataFrame([("r", p) for p in paths], "repository_id string, path string")
    asked = [("js", "../", "index.ts"), ("js", "../x", "x.ts"), ("js", "./x", "a/x.js"), ("js", "./b.c", "a/b.c"), ("js", "./x.jsx", "a/x.jsx"), ("js", "x", None), ("js", "../../x", None), ("py", "x", "x/__init__.py"), ("py", ".", "a/index.py"), ("py", "..", "__init__.py")]
    for lang, target, want in asked:
        got = imports.resolve(spark.createDataFrame([("r", "a/me.ts", lang, target)], "repository_id string, source string, lang string, target string"), files).collect()
        assert [tuple(r) for r in got] == ([("r", "a/me.ts", want)] if want else []), (lang, target)


def test_top_k_per_query_in_blocks(spark, monkeypatch):
    want = sorted(map(tuple, core.QUERIES["vector_topk_per_query"](spark, DATA).collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 6)
    assert sorted(map(tuple, core.QUERIES["vector_topk_per_query"](spark, DATA).collect())) == want


def test_top_k_per_query_at_the_edges(spark):
    """Ties by key, zero and null vectors, fewer items than k, another size."""
    items = spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (1, None), (0, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None)], "query_id string, embedding array<float>")

    def found(i, k):
        return sorted(((r["query_id"], r["rank"], r["vec_id"], r["similarity"]) for r in retrieval.top_k_per_query(i, queries, k, digits=6).collect()), key=str)

    want = [("x", 1, 2, 1.0), ("x", 2, 4, 1.0), ("x", 3, 3, 0.0), ("zero", 1, 2, 0.0), ("zero", 2, 3, 0.0), ("zero", 3, 4, 0.0), ("null", 1, 0, None), ("null", 2, 1, None), ("null", 3, 2, None)]
    assert found(items, 3) == sorted(want, key=str)
    few = items.where("vec_id in (0, 1, 4)")
    assert found(few, 2) == sorted([("x", 1, 4, 1.0), ("x", 2, 0, None), ("zero", 1, 4, 0.0), ("zero", 2, 0, None), ("null", 1, 0, None), ("null", 2, 1, None)], key=str)
    assert retrieval.top_k_per_query(items.limit(0), queries).count() == 0 and retrieval.top_k_per_query(items, queries.limit(0)).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        retrieval.top_k_per_query(items, spark.createDataFrame([("x", [1.0])], queries.schema)).collect()
