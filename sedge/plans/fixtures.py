"""Inputs of the registered queries: a code graph over the star schema, and a few inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

REPO = "parts"
PATH = "concat(p_brand, '/', p_type, '/', p_partkey, '.py')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: brand, type, key.py."""
    return graph.file_nodes(table(spark, sf_dir, "part").select(F.lit(REPO).alias("repository_id"), F.expr(PATH).alias("path")))


def part_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file imports another if its part stands on the line before the other's in an order.

    Lines meet by an equi join on the order and the next number; (order, line) is not unique, so edges are made distinct.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    pairs = li.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> b").select(F.col("l_partkey").alias("a"), "b").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(PATH).alias("path"))
    x = pairs.join(p.toDF("a", "source"), "a").join(p.toDF("b", "target"), "b")
    return x.select(F.lit(REPO).alias("repository_id"), "source", "target")


def part_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    files, edges = part_files(spark, sf_dir), part_imports(spark, sf_dir)
    return graph.Graph(files, edges, graph.module_uses(edges, files))


#: path, content of a small repository with every way of importing that resolves or must not.
SOURCES = (
    ("backend/api.py", "from backend.services import user_service\nimport backend.models\nfrom .services.user_service import X\nfrom . import models\nimport os\n"),
    ("backend/services/user_service.py", "from ..models import M\nfrom ...outside import x\nimport backend.services.user_service\n"),
    ("backend/services/__init__.py", ""),
    ("backend/models.py", "x = 1\n"),
    ("backend/models/__init__.py", ""),
    ("broken.py", "def (:\n"),
    ("frontend/src/App.tsx", "import a from './util'\nimport {b} from \"../lib\"\nexport * from './user.service'\nconst c = require('./exact.js')\nimport './side'\nimport react from 'react'\nimport z from '../../../out'\n"),
    ("frontend/src/util.ts", "import back from './App'\n"),
    ("frontend/lib/index.js", ""),
    ("frontend/src/user.service.ts", ""),
    ("frontend/src/exact.js", ""),
    ("main.py", "import frontend\nfrom backend import api\n"),
)
MANIFESTS = (
    ("r1", "package.json", '{"dependencies": {"react": "1", "next": "1"}, "devDependencies": {"typescript": "5", "react": "2"}}'),
    ("r1", "requirements.txt", "Flask-Cors==1\npandas\n# SQLAlchemy\n"),
    ("r1", "pyproject.toml", '[project]\ndependencies = ["fastapi>=0", "x"]\n[build-system]\nbuild-backend = "poetry.core.masonry.api"\n'),
    ("r2", "package.json", "{not json"),
    ("r2", "pyproject.toml", "[[["),
    ("r3", "package.json", "{}"),
    ("r3", "requirements.txt", ""),
)
QUESTIONS = (
    (1, "How many files are there?"), (2, "how many modules"), (3, "What modules does Brand#13 use?"), (4, "list files in Brand#11"), (5, "list files in brand#11"),
    (6, "Which module does module Brand#12 depend on"), (7, "which files are imported the most?"), (8, "because of the profile"), (9, "who wrote this"), (10, "does the module nothing use it"), (11, "most CENTRAL files"),
)
JS_LINES = (
    (1, "import a from './a'"), (2, 'export { b } from "../b"'), (3, "const c = require('./c'); const d = require(\"d\")"), (4, "import './side'"), (5, "import {\n e } from './e'"), (6, "// import f from './f'"), (7, "import('./g')"), (8, "import h from h"),
)
PATHS = ("backend/app/main.py", "frontend/src/App.tsx", "main.py", ".eslintrc.js", "src/user/UserService.ts", "backend/app/services/x.py", "a/.py", "Dockerfile", "x/node_modules/y.js", "pkg/package-lock.json", "A/B.PY", "docs/README.md", "coverage/z.ts", ".pytest_cache/q.py", "foo.", "Services/thing.py")
REPLIES = (
    (1, '{"answer": "a", "confidence": "high", "sources": ["x"], "graph_context_used": true}'), (2, '```json\n{"answer": "b", "confidence": "low", "sources": [], "graph_context_used": "false"}\n```'), (3, 'Here: {"answer": 1}'), (4, '{"answer": "c", "confidence": "sure", "sources": [], "graph_context_used": 0} and more'), (5, "[1]"), (6, '{"answer": "d"}'),
)


def rows(spark: SparkSession, data: tuple, ddl: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in data], ddl)


# ---------------------------------------------------------------- more rows, and SQL that several queries share

#: Divisor of a part's key, suffix of its path in import_resolve_priority; in the order in which they are tried.
KINDS = ((2, ".ts"), (3, ".js"), (5, "/index.ts"), (7, "/index.js"))
QUESTION = "the thing in that hand"
FLAGS = ("1", "true", " Yes ", "ON", "0", "false", "", "2", None)
#: What SOURCES import, by hand.
EXTRACTED = (
    ("backend/api.py", "py", "backend.services"), ("backend/api.py", "py", "backend.models"), ("backend/api.py", "py", ".services.user_service"), ("backend/api.py", "py", "."), ("backend/api.py", "py", "os"),
    ("backend/services/user_service.py", "py", "..models"), ("backend/services/user_service.py", "py", "...outside"), ("backend/services/user_service.py", "py", "backend.services.user_service"),
    ("frontend/src/App.tsx", "js", "./util"), ("frontend/src/App.tsx", "js", "../lib"), ("frontend/src/App.tsx", "js", "./user.service"), ("frontend/src/App.tsx", "js", "./exact.js"), ("frontend/src/App.tsx", "js", "react"), ("frontend/src/App.tsx", "js", "../../../out"),
    ("frontend/src/util.ts", "js", "./App"), ("main.py", "py", "frontend"), ("main.py", "py", "backend"),
)
RESOLVED = (
    ("backend/api.py", "backend/services/__init__.py"), ("backend/api.py", "backend/models.py"), ("backend/api.py", "backend/services/user_service.py"), ("backend/services/user_service.py", "backend/models.py"),
    ("frontend/src/App.tsx", "frontend/src/util.ts"), ("frontend/src/App.tsx", "frontend/lib/index.js"), ("frontend/src/App.tsx", "frontend/src/exact.js"), ("frontend/src/util.ts", "frontend/src/App.tsx"),
)
_NOT_JSON, _SHAPELESS = "The generator''s reply is not valid JSON.", "The generator''s reply does not have the expected shape."
PARSED = f"(1, 'a', 'high', true, NULL), (2, 'b', 'low', false, NULL), (3, NULL, NULL, NULL, '{_NOT_JSON}'), (4, 'c', 'sure', false, NULL), (5, NULL, NULL, NULL, '{_SHAPELESS}'), (6, NULL, NULL, NULL, '{_SHAPELESS}')"

#: CTEs that give sim (k, similarity to QUESTION) of t (k, text), by the default embedder's rule.
EMBED = rf"""
tw AS (SELECT k, translate(unnest(regexp_extract_all(text, '[A-Za-z][a-z]*|[0-9]+|[^\x00-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM t),
qw AS (SELECT unnest(string_split('{QUESTION}', ' ')) AS w),
wh AS (SELECT w, (h // 2) % 384 AS cell, CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT w, CAST('0x' || md5(w)[1:8] AS BIGINT) AS h FROM (SELECT w FROM tw UNION SELECT w FROM qw))),
tv AS (SELECT k, cell, CAST(sum(s) AS DOUBLE) AS v FROM tw JOIN wh USING (w) GROUP BY k, cell),
qv AS (SELECT cell, CAST(sum(s) AS DOUBLE) AS u FROM qw JOIN wh USING (w) GROUP BY cell),
sc AS (SELECT k, coalesce(sum(v * u), 0) / nullif(sqrt(sum(v * v)) * (SELECT sqrt(sum(u * u)) FROM qv), 0) AS similarity FROM tv LEFT JOIN qv USING (cell) GROUP BY k),
sim AS (SELECT t.k, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(similarity, 0) END AS similarity FROM t LEFT JOIN sc USING (k))"""


def chunk_sql(size: int, overlap: int, table: str = "documents", key: str = "doc_id") -> str:
    return rf"""
SELECT {key}, CAST(i AS INTEGER) AS chunk_index, CAST(i * {size - overlap} + 1 AS INTEGER) AS start_line, CAST(least(i * {size - overlap} + {size}, n) AS INTEGER) AS end_line,
       array_to_string(l[i * {size - overlap} + 1 : i * {size - overlap} + {size}], chr(10)) AS content
FROM (SELECT {key}, l, len(l) AS n, unnest(range(CAST(ceil(len(l) / {size - overlap}.0) AS BIGINT))) AS i
      FROM (SELECT {key}, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT {key}, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM {table})))
"""


def values(rows: tuple) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
