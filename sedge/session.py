"""A session with what the engine expects."""

from pyspark.sql import SparkSession

from .sources.repotree import RepoTree

BATCH_BYTES, _BATCH = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session have some 4 MB, as texts may be long; a smaller setting stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def get_session(app: str = "sedge", **conf: str) -> SparkSession:
    """UTC, adaptive plans, and partition-wise overwrite; sizes of partitions are left to the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return register(builder.getOrCreate())


def register(spark: SparkSession) -> SparkSession:
    """Make the `repotree` source known; its filters are pushed down only where the session lets Python sources do so.
    Arrow batches are bounded."""
    bound_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoTree)
    return spark
