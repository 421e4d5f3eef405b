"""Where scratch tables go."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from sedge.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
from pyspark.sql import SparkSession
from sedge.llm import common, exact_dedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
out = exact_dedup.exact_groups(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
assert sorted((r["doc_id"], r["kept"]) for r in out.collect()) == [(1, False), (2, True)]
print("root", common.scratch_root(spark))
"""


def test_without_a_shared_folder(tmp_path):
    """A session of this machine alone takes a temporary folder, and nothing is left in it."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    root = next(x for x in done.stdout.splitlines() if x.startswith("root ")).split("file://")[1]
    assert not os.path.exists(root)


def test_cluster_without_a_shared_folder():
    fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none", master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.scratch_root(fake)


def test_tables_can_be_discarded(spark):
    t = common.materialize(spark.range(3), "test")
    path = t._sedge_path.removeprefix("file://")
    assert os.path.exists(path)
    common.discard(t, spark.range(1))
    assert not os.path.exists(path)


def test_batches_are_bounded(spark):
    """Larger and unlimited settings are lowered, smaller ones stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        for given, want in (("64m", common.BATCH_BYTES), ("1g", common.BATCH_BYTES), ("1m", 1 << 20), ("5000b", 5000)):
            spark.conf.set(key, given)
            common.bound_batches(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, was)
