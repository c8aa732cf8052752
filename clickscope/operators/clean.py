"""Cleaning: keep-first dedup, behavior and date-range filters, local time, audits.

Plan shape of ``clean_events`` (checked with ``explain``): one hash exchange on the
dedup key.  ``row_number() == 1`` is planned as a *partial* ``WindowGroupLimit`` before
the exchange and a final one after it, so each map task ships at most one row per key:
a key holding a third of all rows is reduced map-side, never sorted in one task.  The
date-range predicate is stated on ``timestamp`` (a dedup key column), so Catalyst moves
it below the window and into the scan; the behavior predicate must stay above the
dedup (an invalid first row wins its key) and does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscope.functions.numeric import clip_lower
from clickscope.functions.timefn import (
    date_string,
    datetime_string,
    hour_of,
    local_datetime,
    ntz_literal,
    weekday_monday0,
)
from clickscope.operators.distinct import distinct_counts, distinct_partials, merge_partials
from clickscope.params import CleanParams
from clickscope.schemas import CLEANED_COLUMNS
from clickscope.sources.raw import ORDER_COL

_P = CleanParams()


def dedup_keep_first(df: DataFrame, key=_P.dedup_key, order_col: str = ORDER_COL) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each key; null keys are equal."""
    w = Window.partitionBy(*key).orderBy(F.col(order_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def behavior_predicate(behaviors=_P.behaviors) -> Column:
    """Membership in the valid behaviors; null is not a member."""
    return F.coalesce(F.col("behavior").isin(list(behaviors)), F.lit(False))


def filter_behavior(df: DataFrame, behaviors=_P.behaviors) -> DataFrame:
    return df.filter(behavior_predicate(behaviors))


def with_local_time(df: DataFrame, params: CleanParams = _P, epoch_col: str = "timestamp") -> DataFrame:
    """Adds ``datetime`` (naive local), ``date`` (yyyy-MM-dd), ``hour`` and ``weekday``
    (Monday = 0)."""
    dt = local_datetime(epoch_col, params.utc_offset_hours, params.tz_mode, params.time_zone)
    return (
        df.withColumn("datetime", dt)
        .withColumn("date", date_string("datetime"))
        .withColumn("hour", hour_of("datetime"))
        .withColumn("weekday", weekday_monday0("datetime"))
    )


def range_predicate(params: CleanParams = _P) -> Column:
    """Half-open local-date range ``[start, end + 1 day)``.

    With a fixed offset the range is an epoch-second range, stated on ``timestamp`` so
    it pushes below the dedup and into the scan.  With zone rules it is stated on the
    local ``datetime`` (Catalyst still moves it below the dedup, as ``datetime`` is
    computed from a key column)."""
    if params.tz_mode == "fixed":
        lo, hi = params.epoch_bounds()
        return (F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi))
    return (F.col("datetime") >= ntz_literal(params.start_local)) & (
        F.col("datetime") < ntz_literal(params.end_local_exclusive)
    )


def filter_date_range(df: DataFrame, params: CleanParams = _P) -> DataFrame:
    """Date-range filter on a frame that has ``timestamp`` (and ``datetime`` in zone mode)."""
    if params.tz_mode != "fixed" and "datetime" not in df.columns:
        df = with_local_time(df, params)
    return df.filter(F.coalesce(range_predicate(params), F.lit(False)))


def id_column(name: str, on_bad_id: str = "fail") -> Column:
    """Narrow an id to INT.  ``fail``: ANSI cast (overflow raises);
    ``minus_one``: unparsable, too large or null -> -1; ``null``: -> null."""
    c = F.col(name)
    if on_bad_id == "fail":
        return c.cast("int").alias(name)
    if on_bad_id == "minus_one":
        return F.coalesce(c.try_cast("int"), F.lit(-1)).alias(name)
    if on_bad_id == "null":
        return c.try_cast("int").alias(name)
    raise ValueError(f"unknown on_bad_id {on_bad_id!r}")


def coerce_ids(df: DataFrame, columns=("user_id", "item_id", "category_id")) -> DataFrame:
    """The chunked engine's coercion: bad or null id -> -1, as INT."""
    return df.select(*[id_column(c, "minus_one") if c in columns else F.col(c) for c in df.columns])


def _finish(df: DataFrame, params: CleanParams) -> DataFrame:
    return df.select(
        id_column("user_id", params.on_bad_id),
        id_column("item_id", params.on_bad_id),
        id_column("category_id", params.on_bad_id),
        F.col("behavior").cast("string").alias("behavior"),
        F.col("timestamp").cast("long").alias("timestamp"),
        "datetime", "date", "hour", "weekday",
    )


def clean_after_dedup(deduped: DataFrame, params: CleanParams = _P) -> DataFrame:
    """Behavior filter -> local time -> range filter -> casts -> the nine columns.
    Shared by the batch job and the stream job."""
    kept = filter_behavior(deduped, params.behaviors)
    kept = with_local_time(kept, params)
    kept = kept.filter(F.coalesce(range_predicate(params), F.lit(False)))
    return _finish(kept, params)


def clean_events(raw: DataFrame, params: CleanParams = _P, order_col: str = ORDER_COL) -> DataFrame:
    """Raw log -> cleaned events (nine columns).

    ``dedup_scope="before_filter"``: keep-first over all raw rows, then the filters
    (an invalid first row removes its valid duplicate).  ``"after_filter"``: filters
    first, then keep-first among the rows that passed."""
    if params.dedup_scope == "before_filter":
        return clean_after_dedup(dedup_keep_first(raw, params.dedup_key, order_col), params)
    if params.dedup_scope == "after_filter":
        passed = with_local_time(filter_behavior(raw, params.behaviors), params)
        passed = passed.filter(F.coalesce(range_predicate(params), F.lit(False)))
        return _finish(dedup_keep_first(passed, params.dedup_key, order_col), params)
    raise ValueError(f"unknown dedup_scope {params.dedup_scope!r}")


# --------------------------------------------------------------------------- audits


def merge_one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates with disjoint column sets into one row: union by name
    (missing columns null), then the single non-null value of each column.  Works for
    maps and arrays too; no join."""
    cols = [c for f in frames for c in f.columns]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def cleaning_audit(raw: DataFrame, cleaned: DataFrame, params: CleanParams = _P,
                   raw_rows: DataFrame | None = None) -> DataFrame:
    """Audit counters in the default engine's "full" definitions: behavior and range
    violations are counted on the raw, un-deduplicated rows.

    ``raw_rows``: a one-row ``raw_rows`` frame (the line count of the CSV); when absent
    the raw row count is used."""
    valid = behavior_predicate(params.behaviors)
    if params.tz_mode == "fixed":
        raw_t = raw
    else:
        raw_t = with_local_time(raw, params)
    in_range = F.coalesce(range_predicate(params), F.lit(False))
    raw_stats = raw_t.agg(
        F.count_if(valid).alias("after_behavior_filter_rows"),
        F.count_if(valid & ~in_range).alias("out_of_range_rows"),
        *([] if raw_rows is not None else [F.count(F.lit(1)).alias("raw_rows")]),
    )
    final = cleaned.agg(F.count(F.lit(1)).alias("final_rows"))
    parts = [raw_stats, final] + ([raw_rows.select("raw_rows")] if raw_rows is not None else [])
    m = merge_one_row(*parts)
    after_date = F.col("after_behavior_filter_rows") - F.col("out_of_range_rows")
    return m.select(
        F.col("raw_rows").cast("long").alias("raw_rows"),
        F.col("after_behavior_filter_rows").cast("long").alias("after_behavior_filter_rows"),
        F.col("out_of_range_rows").cast("long").alias("out_of_range_rows"),
        after_date.cast("long").alias("after_date_filter_rows"),
        (F.col("raw_rows") - F.col("after_behavior_filter_rows")).cast("long").alias("invalid_behavior_rows"),
        F.col("final_rows").cast("long").alias("final_rows"),
        clip_lower(after_date - F.col("final_rows"), 0).cast("long").alias("global_duplicate_rows"),
        clip_lower(F.col("raw_rows") - F.col("final_rows"), 0).cast("long").alias("total_removed_rows"),
    )


def cleaning_stage_counts(raw: DataFrame, params: CleanParams = _P, order_col: str = ORDER_COL) -> DataFrame:
    """Stage-by-stage counters (raw -> after dedup -> after behavior -> after date), with
    the flags evaluated on the dedup winners in one aggregate."""
    deduped = dedup_keep_first(raw, params.dedup_key, order_col)
    if params.tz_mode != "fixed":
        deduped = with_local_time(deduped, params)
    valid = behavior_predicate(params.behaviors)
    in_range = F.coalesce(range_predicate(params), F.lit(False))
    stages = deduped.agg(
        F.count(F.lit(1)).alias("after_dedup_rows"),
        F.count_if(valid).alias("after_behavior_filter_rows"),
        F.count_if(valid & in_range).alias("after_date_filter_rows"),
    )
    m = merge_one_row(raw.agg(F.count(F.lit(1)).alias("raw_rows")), stages)
    return m.select(
        F.col("raw_rows").cast("long").alias("raw_rows"),
        F.col("after_dedup_rows").cast("long").alias("after_dedup_rows"),
        F.col("after_behavior_filter_rows").cast("long").alias("after_behavior_filter_rows"),
        F.col("after_date_filter_rows").cast("long").alias("after_date_filter_rows"),
        (F.col("raw_rows") - F.col("after_dedup_rows")).cast("long").alias("duplicate_rows"),
        (F.col("after_dedup_rows") - F.col("after_behavior_filter_rows")).cast("long").alias("invalid_behavior_rows"),
        (F.col("after_behavior_filter_rows") - F.col("after_date_filter_rows")).cast("long").alias("out_of_range_rows"),
    )


#: Counted id columns and the names of their counts.
OVERVIEW_IDS = {"user_id": "user_count", "item_id": "item_count", "category_id": "category_count"}


def overview_partials(cleaned: DataFrame, by: tuple[str, ...] = ("date",)) -> tuple[DataFrame, DataFrame]:
    """What an overview needs, per ``by``, in a form that merges: ``(rows, ids)``.

    ``rows``: ``by..., final_rows, first, last``; ``ids``: the bitmaps of the id columns
    (``distinct.distinct_partials``).  Partials of several loads merge after a union.
    ``cleaned`` is read once a column: store it."""
    rows = cleaned.groupBy(*by) if by else cleaned
    rows = rows.agg(F.count(F.lit(1)).alias("final_rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    return rows, distinct_partials(cleaned, list(OVERVIEW_IDS), by)


def overview_of_partials(rows: DataFrame, ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The overview of merged partials, per ``by`` or as one row: no access to the log."""
    counts = distinct_counts(merge_partials(ids, by), list(OVERVIEW_IDS), by)
    counts = counts.select(*by, *[F.col(c).alias(n) for c, n in OVERVIEW_IDS.items()])
    totals = (rows.groupBy(*by) if by else rows).agg(
        F.coalesce(F.sum("final_rows"), F.lit(0)).cast("long").alias("final_rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    names = ["final_rows", *OVERVIEW_IDS.values(), "first", "last"]
    if by:  # a row a group on both sides
        both = totals.unionByName(counts, allowMissingColumns=True).groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    else:
        both = merge_one_row(totals, counts)
    return both.select(*by, *names[:-2], datetime_string(F.col("first")).alias("start"), datetime_string(F.col("last")).alias("end"))


def cleaning_overview(cleaned: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct users / items / categories, first and last local datetime.  Exact
    counts come from bitmaps, one column-pruned pass a column: store ``cleaned`` first.
    ``approximate`` swaps them for HyperLogLog++ sketches in a single pass."""
    if not approximate:
        return overview_of_partials(*overview_partials(cleaned, ()))
    return cleaned.agg(
        F.count(F.lit(1)).alias("final_rows"),
        *[F.approx_count_distinct(c).alias(n) for c, n in OVERVIEW_IDS.items()],
        datetime_string(F.min("datetime")).alias("start"),
        datetime_string(F.max("datetime")).alias("end"),
    )


def behavior_counts(cleaned: DataFrame) -> DataFrame:
    """Rows per behavior, sorted by behavior."""
    return cleaned.groupBy("behavior").agg(F.count(F.lit(1)).alias("rows")).orderBy("behavior")


def overview(cleaned: DataFrame) -> DataFrame:
    """Dashboard KPIs: rows, users, items, first and last day (date prefix)."""
    o = cleaning_overview(cleaned)
    return o.select(
        "final_rows", "user_count", "item_count",
        F.substring("start", 1, 10).alias("first_day"),
        F.substring("end", 1, 10).alias("last_day"),
    )


def overview_of_summary(summary: DataFrame) -> DataFrame:
    """The KPIs from a stored cleaning summary document, without the events.  One row also
    where no document is: its figures are null then (not made yet)."""
    date = lambda end: F.substring(F.col("date_range")[end], 1, 10)
    kpis = {"final_rows": F.coalesce("final_rows", F.lit(0)), "user_count": F.coalesce("user_count", F.lit(0)),
            "item_count": F.coalesce("item_count", F.lit(0)), "first_day": date("start"), "last_day": date("end")}
    return summary.select(*[c.alias(n) for n, c in kpis.items()]).agg(*[F.first(n).alias(n) for n in kpis])


def cleaning_summary(raw: DataFrame, cleaned: DataFrame, params: CleanParams = _P,
                     raw_rows: DataFrame | None = None) -> DataFrame:
    """The cleaning summary document as one row (map of behavior counts, date range
    struct).  The behavior map is built from a grouped result (one row per behavior)."""
    audit = cleaning_audit(raw, cleaned, params, raw_rows)
    ov = cleaning_overview(cleaned).drop("final_rows")
    bmap = behavior_counts(cleaned).agg(
        F.map_from_entries(F.collect_list(F.struct("behavior", "rows"))).alias("behavior_counts")
    )
    m = merge_one_row(audit, ov, bmap)
    return m.select(
        *audit.columns, "user_count", "item_count", "category_count", "behavior_counts",
        F.struct(F.col("start"), F.col("end")).alias("date_range"),
    )


__all__ = [
    "dedup_keep_first", "filter_behavior", "filter_date_range", "with_local_time", "coerce_ids",
    "clean_events", "clean_after_dedup", "cleaning_audit", "cleaning_stage_counts", "cleaning_overview",
    "overview_partials", "overview_of_partials", "overview_of_summary", "behavior_counts", "overview", "cleaning_summary", "CLEANED_COLUMNS",
]
