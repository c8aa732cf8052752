"""Session helpers: a local session for tests and benches, the shared folder, skew settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "clickscope") -> SparkSession:
    """A ``local[cores]`` session for tests and benches (never used on a cluster)."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLICKSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private one created.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="clickscope-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (unique per call)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/clickscope/{name}-{uuid.uuid4().hex[:12]}"


def tune_for_skew(spark: SparkSession) -> None:
    """Let AQE split skewed join partitions even when an aggregate on the same key
    follows (the funnel's threshold joins).  Settings the user made are left alone."""
    for key, value in (
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def materialize(df, name: str = "table"):
    """Store ``df`` as a Parquet table in the shared checkpoint folder and read it back:
    a table that several jobs read is computed once, survives executor loss and cuts
    lineage.  One write job (an eager ``checkpoint()`` runs the plan twice: a count, then
    the file write), columnar and compressed, and the read-back has statistics."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
