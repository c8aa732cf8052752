"""Site-relative line dedup.

Pages are grouped by host.  A line's frequency at a host is the number of the host's
pages that contain it over the host's number of pages; pages with one and the same text
count once, so copies of a page do not turn its content into boilerplate.  Lines whose
frequency is over ``ratio`` are boilerplate of that host and are dropped from its pages.
Every host is judged, however few its pages; a line must stand on ``min_pages`` of them,
as one page, or two, show no habit of a host.

Plan: (1) distinct (host, text digest) with the distinct line digests of each text, (2)
counts by (host, line) and by host, combined before the shuffle, (3) the boilerplate
digests of each host in one row (at most mean lines a page / ``ratio`` of them, so a
host's row is small however many pages it has), joined to the pages by host, (4) the
lines filtered in place.  Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscope.llm.common import broadcast_checked, fresh, materialize

RATIO = 0.05
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Digest of a line without white space at its ends (128 bits, as two longs)."""
    bare = F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(F.length(bare) > 0, F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit(1), bare).alias("y")))


def boilerplate_lines(df: DataFrame, host_col: str = "source", text_col: str = "text",
                      ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line_x, line_y, n_pages, host_pages)`` of every line, by digest, on more
    than ``ratio`` of its host's distinct pages and on ``min_pages`` of them.

    Null is a host like any other.  Null and empty texts are pages without lines; blank
    lines never are boilerplate; a line's repeats on one page count once."""
    # sketch the lines of each text before the shuffle that makes texts distinct
    pages = df.select(
        F.col(host_col).alias("host"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"),
        F.array_distinct(F.filter(F.transform(_lines(F.col(text_col)), _key), lambda k: k.isNotNull())).alias("lines"))
    distinct = materialize(pages.groupBy("host", "digest").agg(F.first("lines").alias("lines")).drop("digest"), "page_lines")
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    totals = materialize(totals.withColumnRenamed("host", "site"), "host_pages")
    counts = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = counts.where(F.col("n_pages") >= min_pages)
    return (counts.join(broadcast_checked(totals), F.col("host").eqNullSafe(F.col("site"))).where(F.col("n_pages") > ratio * F.col("host_pages"))
            .select("host", F.col("line.x").alias("line_x"), F.col("line.y").alias("line_y"), "n_pages", "host_pages"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text",
                     ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with each host's boilerplate lines cut out of the texts.

    All rows and columns stay, in meaning and order of lines; a text of nothing but
    boilerplate becomes empty; a null text stays null; texts without boilerplate are
    unchanged to the byte; an empty table gives an empty one."""
    host, bad = fresh(df, "_host"), fresh(df, "_bad")
    found = boilerplate_lines(df, host_col, text_col, ratio, min_pages)
    of_host = materialize(found.groupBy("host").agg(
        F.collect_list(F.struct(F.col("line_x").alias("x"), F.col("line_y").alias("y"))).alias("bad")), "boilerplate")
    of_host = of_host.select(F.col("host").alias(host), F.col("bad").alias(bad))
    text = F.col(text_col)
    kept = F.array_join(F.filter(_lines(text), lambda line: ~F.coalesce(F.array_contains(F.col(bad), _key(line)), F.lit(False))), "\n")
    cleaned = F.when(F.col(bad).isNull() | text.isNull(), text).otherwise(kept)
    joined = df.join(broadcast_checked(of_host, weight=F.size(bad)), df[host_col].eqNullSafe(of_host[host]), "left")
    return joined.select(*[cleaned.alias(c) if c == text_col else df[c] for c in df.columns])


def line_dedup_report(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                      ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each row of ``df``: id, lines before and after, digest of the text left."""
    before = fresh(df, "_before")
    both = df.select(id_col, host_col, text_col, F.col(text_col).alias(before))
    n = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)).cast("long")
    return drop_boilerplate(both, host_col, text_col, ratio, min_pages).select(
        id_col, n(before).alias("n_lines"),
        F.when(F.col(text_col).eqNullSafe(F.col(before)), F.lit(0))
        .otherwise(n(before) - F.when(F.col(text_col) == "", F.lit(0)).otherwise(n(text_col))).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
