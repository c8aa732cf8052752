"""Writers: cleaned Parquet (zstd, bounded files, overwrite) and summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_ROWS = 1_000_000


def write_cleaned(cleaned: DataFrame, path: str, partition_by_date: bool = False,
                  max_records_per_file: int = 4 * ROW_GROUP_ROWS) -> str:
    """Write cleaned events as zstd Parquet, replacing what was there.

    Column statistics are on by default (min/max skipping).  ``partition_by_date`` adds
    directory partition pruning on ``date``.  Files are bounded by
    ``max_records_per_file``."""
    writer = (
        cleaned.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", str(128 * 1024 * 1024))
        .option("maxRecordsPerFile", str(max_records_per_file))
    )
    if partition_by_date:
        writer = writer.partitionBy("date")
    writer.parquet(path)
    return path


def write_cleaned_observed(cleaned: DataFrame, path: str, **kw) -> dict:
    """Write and count in the same pass: ``DataFrame.observe`` collects the final row
    count and per-behavior counts while the write job runs (no second scan).  The
    metrics are gathered in the write's result stage, where each task counts once."""
    obs = Observation(f"clean_write_{abs(hash(path))}")
    observed = cleaned.observe(
        obs,
        F.count(F.lit(1)).alias("final_rows"),
        *[F.count_if(F.col("behavior") == b).alias(f"n_{b}") for b in ("pv", "fav", "cart", "buy")],
    )
    write_cleaned(observed, path, **kw)
    return obs.get


def write_compacted(df: DataFrame, path: str, **kw) -> tuple[str, int]:
    """Write ``df`` in files of AQE's advisory size and count its rows in the same pass.
    Returns ``(path, rows)``.

    One way for every size: the ``REBALANCE`` hint lets AQE merge small shuffle partitions
    (a small result is one file) and split large ones, whichever way the rows were dealt."""
    return path, int(write_cleaned_observed(df.hint("rebalance"), path, **kw)["final_rows"])


def write_summary_json(summary: DataFrame, path: str) -> str:
    """A summary document (one-row DataFrame, nested types allowed) as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_summary_json(spark: SparkSession, path: str, schema, default: DataFrame | None = None) -> DataFrame:
    """Read a summary document with its declared schema; ``default`` when absent."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        if default is None:
            return spark.createDataFrame([], schema)
        return default
    return spark.read.schema(schema).json(path)
