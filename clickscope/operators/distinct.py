"""Mergeable exact distinct counts of integer ids by bitmaps.

The distinct ids of a column are a set of bitmaps, each over 32,768 neighbouring ids
(``bitmap_bucket_number`` / ``bitmap_bit_position``).  The bitmaps of a day are a *partial*:
days, months or loads merge by OR, without the log, and a count of bits is exact.  A null
is one value, kept as a row of no bucket.

Each column is one aggregate over a scan of that column alone, combined in the map tasks: a
row a bucket leaves a task, however often an id occurs.  No row is expanded into one per
column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_partials(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., column, bucket, bits, rows``: the ids of every integer column as bitmaps.  A row
    with a null ``bucket`` stands for nulls; ``rows`` are the input rows behind a row.

    One scan a column: ``df`` should be stored."""
    def one(c: str) -> DataFrame:
        value = F.col(c).cast("long")
        bucket = F.bitmap_bucket_number(value)
        own = df.select(*by, bucket.alias("bucket"), F.bitmap_bit_position(value).alias("bit"))
        return own.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("rows")).select(
            *by, F.lit(c).alias("column"), "bucket", "bits", "rows")

    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def merge_partials(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Partials of fewer ``by`` columns (or of several tables, after a union) as one."""
    return partials.groupBy(*by, "column", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))


def distinct_counts(merged: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., <column>...``: distinct values of each column, null being one, from merged
    partials (one row for each bucket).  Without ``by`` one row, also for an empty table."""
    def values(c: str) -> Column:
        bits = F.when(F.col("bucket").isNull(), F.lit(1).cast("long")).otherwise(F.bitmap_count("bits"))
        return F.coalesce(F.sum(F.when(F.col("column") == c, bits)), F.lit(0).cast("long")).alias(c)

    found = [values(c) for c in columns]
    return merged.groupBy(*by).agg(*found) if by else merged.agg(*found)


__all__ = ["distinct_partials", "merge_partials", "distinct_counts"]
