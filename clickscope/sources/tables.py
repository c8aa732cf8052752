"""Readers of cleaned tables and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.schemas import CLEANED

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}


def scan_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Lazy Parquet scan of a cleaned dataset (file or directory, partitioned by date or
    not) with the declared schema, so a ``date`` partition column stays a string."""
    return spark.read.schema(CLEANED).parquet(path)


def load_cleaned(spark: SparkSession, path: str, columns: list[str] | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """Cleaned table with a projection, read with the declared schema: ``date`` is a
    string also where it is a partition folder, ``datetime`` of a CSV comes back typed.  The
    projection reaches the scan (``ReadSchema``).  ``fmt="parts"`` reads a folder of Parquet
    and CSV parts, in any mixture."""
    if fmt == "parts":
        df = read_table(spark, path, CLEANED)
    elif fmt == "csv":
        df = spark.read.schema(CLEANED).option("header", "true").csv(path)
    else:
        df = spark.read.schema(CLEANED).format(fmt).load(path)
    return df.select(*columns) if columns else df


def _format_of(path: str) -> str | None:
    for suffix, fmt in _FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return fmt
    return None


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table by suffix; a directory is the union of its ``.parquet`` and ``.csv``
    children (by name, in path order), one without any an empty table of ``schema`` (of no
    columns without one).  An unknown suffix is an error."""
    fmt = _format_of(path)
    if fmt is not None:
        reader = spark.read
        if fmt == "csv":
            reader = reader.option("header", "true")
            if schema is not None:
                reader = reader.schema(schema)
        return reader.format(fmt).load(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(jvm_path).isDirectory():
        raise ValueError(f"unsupported table file type: {path}")
    children = sorted(str(st.getPath().toString()) for st in fs.listStatus(jvm_path))
    parts = [c for c in children if _format_of(c) in ("parquet", "csv")]
    if not parts:
        return spark.createDataFrame([], schema or T.StructType([]))
    frames = [read_table(spark, c, schema) for c in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cast_to(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
