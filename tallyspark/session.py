"""Session settings the jobs are written for, and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .errors import UnusableInput

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "tallyspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above; keyword ``conf`` values override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; there a fresh temporary folder is used. On a
    cluster such a folder would be on one machine and vanish with it, so that is refused.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise UnusableInput("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tallyspark-")
    return _local_root


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables staged inside belong to one run and are dropped at its end, however
    it ends. Results that are read off them must be written before.

    A scope inside another has a folder of its own. What other runs have staged is not touched.
    """
    folder = f"{_scope.get() or staging_root(spark)}/run-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, label: str) -> str:
    """A path below the staging root, or the run's folder, that no other call gets."""
    return f"{_scope.get() or staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the staging folder and read it back.

    Used where several jobs read the same intermediate result. The written table cuts the
    lineage, survives lost executors, and still gives later readers column pruning and
    filter pushdown.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
