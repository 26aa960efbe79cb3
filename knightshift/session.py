"""Session helpers: building a session for tests/bench and finding shared scratch space.

On a cluster the operator of the cluster names a shared folder in
``spark.checkpoint.dir``; every intermediate table this library writes
(sink round trips, lineage cuts, streaming checkpoints) goes below it.
Only when nothing is configured (unit tests, local runs) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults used by tests and bench.py; a cluster session keeps its own settings.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def cluster_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings sized for a cluster job over ``input_bytes`` of Parquet/text.

    About 256 MB per scan split and per shuffle partition of an unreduced
    join, and at least two waves of the cores; AQE coalesces the partitions
    that aggregation leaves small and splits skewed ones.  Broadcasts stay
    small because every broadcast in this library is behind a check of its bytes.
    """
    target = 256 * 1024 * 1024
    parts = max(2 * total_cores, -(-input_bytes // target))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Set runtime SQL settings on a running session."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def get_spark(app: str = "knightshift", master: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks (cluster jobs bring their own)."""
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("KS_MASTER", "local[8]"))
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Read from the session; only when it is unset on a local master (tests) a
    private folder is created and registered as the checkpoint dir.  Elsewhere
    an unset folder is an error: a driver's folder is not shared with executors.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="knightshift-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/ks-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage with a written table in the shared folder.

    The rows are written once as Parquet under ``spark.checkpoint.dir`` and
    read back: later stages plan against a plain scan (file statistics drive
    broadcast decisions, adaptive execution keeps coalescing partitions), and
    a lost executor re-reads the files instead of recomputing the plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    back.scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(conf).delete(path, True)


_LANDED: dict[tuple[str, str], str] = {}


def landed(spark: SparkSession, key: str, build) -> str:
    """Input files derived from the tables (a match file, a puzzle dump, a result
    table) are landed once per application and reused by every query that reads
    them; ``build(path)`` writes them."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _LANDED:
        path = scratch_path(spark, "landed")
        build(path)
        _LANDED[k] = path
    return _LANDED[k]
