"""Header-less CSV click logs: declared schema, first-seen order key, raw line count."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickscope.schemas import RAW

ORDER_COL = "ord"


def read_raw(spark: SparkSession, path: str | list[str], on_bad_id: str = "fail") -> DataFrame:
    """Scan a header-less CSV with the declared raw schema and no inference.

    ``on_bad_id="fail"`` uses ``FAILFAST``.  CSV column pruning is switched off so that
    a malformed line fails even when only some columns are selected downstream."""
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    mode = "FAILFAST" if on_bad_id == "fail" else "PERMISSIVE"
    return (
        spark.read.schema(RAW)
        .option("header", "false")
        .option("mode", mode)
        .csv(path)
    )


# Up to this many files (some 100 bytes each) the listing is broadcast; Spark shuffles beyond.
BROADCAST_FILES = 200_000
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def _norm_path(p: str) -> str:
    return re.sub(_SCHEME, r"\1:///", p)


def read_raw_ordered(spark: SparkSession, path: str | list[str], on_bad_id: str = "fail") -> DataFrame:
    """``read_raw`` plus ``ord``: the line's first-seen position as a sortable struct
    ``(file, block, row)``.

    Files order by path; inside a file the split start orders the splits, and
    ``monotonically_increasing_id`` grows with the line inside one split.  The struct
    therefore sorts exactly like the line order of the concatenated input, without a
    single-partition numbering pass.  ``file`` is the file's position in the sorted
    file list, so the dedup shuffle carries an int instead of a path string; the listing,
    which the driver already holds, is broadcast up to ``BROADCAST_FILES`` files."""
    df = read_raw(spark, path, on_bad_id)
    cols = [c for c in df.columns]
    meta = df.select(
        *cols,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    files = sorted({_norm_path(p) for p in df.inputFiles()})
    listing = spark.createDataFrame(list(enumerate(files)), "_file_idx int, _file_key string")
    if len(files) <= BROADCAST_FILES:
        listing = F.broadcast(listing)
    meta = meta.join(listing, F.regexp_replace("_file", _SCHEME, "$1:///") == F.col("_file_key"), "left")
    file_part = F.when(F.col("_file_idx").isNull(), F.raise_error(F.concat(
        F.lit("input file missing from the listing: "), F.col("_file")))).otherwise(F.col("_file_idx"))
    return meta.select(
        *cols,
        F.struct(file_part.alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row")).alias(ORDER_COL),
    )


def raw_row_count(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw line count as one row ``raw_rows``: newline-terminated lines plus an
    unterminated tail; blank lines count (the CSV reader would skip them), a lone
    carriage return does not end a line."""
    return spark.read.option("lineSep", "\n").text(path).agg(F.count(F.lit(1)).alias("raw_rows"))


def write_raw_csv(raw: DataFrame, path: str, order_col: str | None = ORDER_COL) -> str:
    """Write a raw log as header-less CSV part files, rows in ``order_col`` order
    (a distributed range sort: part files follow the order, so path order = line order)."""
    cols = [c.name for c in RAW.fields]
    out = raw
    if order_col is not None:
        out = out.orderBy(order_col)
    out.select(*cols).write.mode("overwrite").option("header", "false").csv(path)
    return path
