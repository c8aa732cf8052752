"""RFM: recency / frequency / monetary per buyer, scores, levels, segments, summaries.

Per-user aggregates are hash aggregates with map-side combine; the distinct category
count is planned as an aggregate on ``(user, category)`` first, so one heavy buyer is
spread over categories and pre-reduced.  Scores don't rank the users: the limits of the
quantile bins and the medians are order statistics of the value counts of the three
metrics, found by range counts, and where a limit falls among users of
one value, a second selection finds the user id that parts them.  So a score is an
expression over literals, and no step sorts users or holds all values in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from clickscope.functions.numeric import half_even
from clickscope.functions.timefn import elapsed_days
from clickscope.operators.rank import bin_limits, order_statistics, unique_ranks
from clickscope.params import SEGMENT_LABELS, RfmParams
from clickscope.session import materialize

_P = RfmParams()
METRICS = ("recency", "frequency", "monetary")
SHORT = {"recency": "r", "frequency": "f", "monetary": "m"}
HIGHER_IS_BETTER = {"recency": False, "frequency": True, "monetary": True}
RFM_COLUMNS = ["user_id", "last_buy_time", "frequency", "category_count", "recency", "monetary"]
SCORE_COLUMNS = ["r_score", "f_score", "m_score", "r_level", "f_level", "m_level", "segment"]


def buy_events(events: DataFrame, params: RfmParams = _P) -> DataFrame:
    return events.filter(F.col("behavior").cast("string") == params.buy_behavior)


def rfm_base(events: DataFrame, params: RfmParams = _P) -> DataFrame:
    """Unscored RFM table, one row per buyer."""
    # an event without a user belongs to no buyer
    g = buy_events(events, params).where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("datetime").alias("last_buy_time"),
        F.count("item_id").alias("frequency"),
        F.count_distinct("category_id").alias("category_count"),
    )
    monetary = F.col("category_count") if params.monetary_mode == "category_count" else F.col("frequency")
    return g.select(
        "user_id", "last_buy_time",
        F.col("frequency").cast("long").alias("frequency"),
        F.col("category_count").cast("long").alias("category_count"),
        elapsed_days("last_buy_time", params.end_instant).alias("recency"),
        monetary.cast("long").alias("monetary"),
    )


def value_triples(rfm: DataFrame) -> DataFrame:
    """The distinct ``(recency, frequency, monetary)`` and ``n``, the users of each."""
    return rfm.groupBy(*METRICS).agg(F.count(F.lit(1)).alias("n"))


def value_counts(rfm: DataFrame) -> DataFrame:
    """``metric, value, n``: the value-count tables of the three metrics, from the triples."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in METRICS]))
    stacked = value_triples(rfm).select("n", each.alias("v")).where("v.value IS NOT NULL")
    return stacked.groupBy("v.metric", "v.value").agg(F.sum("n").alias("n"))


def _middle(n: int) -> tuple[int, int]:
    return (n + 1) // 2, n // 2 + 1


def stored_with_bounds(rfm: DataFrame) -> tuple[DataFrame, dict]:
    """``rfm`` stored, its row count ``n`` and the least and greatest of each metric and of
    the user ids, observed while it is written."""
    seen = Observation()
    ends = [f(F.col(c).cast("long")).alias(f"{c}_{f.__name__}") for c in (*METRICS, "user_id") for f in (F.min, F.max)]
    stored = materialize(rfm.observe(seen, F.count(F.lit(1)).alias("n"), *ends), "rfm")
    return stored, seen.get


def rfm_stats(rfm: DataFrame, ends: dict, bins: int | None = None) -> dict:
    """Per metric the exact ``median`` and, for ``bins``, the order statistics of the bins'
    upper ranks (``limits``; none for a metric of fewer values than bins), from the counts of
    the triples.  Empty for an empty table."""
    n = ends["n"]
    if not n:
        return {}
    limits = bin_limits(n, bins) if bins else []
    bounds = {m: (ends[f"{m}_min"], ends[f"{m}_max"]) for m in METRICS}
    found, distinct = order_statistics(value_triples(rfm), {m: (None, m, sorted({*_middle(n), *limits})) for m in METRICS}, bounds, "n")
    stats = {}
    for m in METRICS:
        low, high = (found[m, k].value for k in _middle(n))
        enough = not bins or distinct[m] >= bins
        if not enough and bounds[m][1] - bounds[m][0] >= 1 << 14:  # few cells, but of many values each
            enough = rfm.agg(F.count_distinct(m)).first()[0] >= bins
        stats[m] = {"median": (low + high) / 2.0, "limits": [(k, found[m, k]) for k in limits] if enough else []}
    return stats


def level_of(col: str, median: float | None, higher_is_better: bool) -> Column:
    """Median split: 2 when at or above the median (at or below for recency), else 1."""
    c = F.col(col)
    if median is None:
        return F.lit(None).cast("tinyint")
    hit = c >= F.lit(float(median)) if higher_is_better else c <= F.lit(float(median))
    return F.when(hit, 2).otherwise(1).cast("tinyint")


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment label of the (r, f, m) levels: an 8-entry literal map."""
    key = r.cast("int") * 100 + f.cast("int") * 10 + m.cast("int")
    pairs = []
    for (a, b, c), label in SEGMENT_LABELS.items():
        pairs += [F.lit(a * 100 + b * 10 + c), F.lit(label)]
    return F.element_at(F.create_map(*pairs), key)


def _parting_ids(rfm: DataFrame, ends: dict, stats: dict) -> dict:
    """``(metric, upper rank) -> user id``: where a limit falls among users of one value, the
    last of them (by id) in the lower bin."""
    ties = {(m, k): at for m, s in stats.items() for k, at in s["limits"] if at.below < k < at.below + at.equal}
    wanted = {t: (F.col(t[0]) == at.value, "user_id", [t[1] - at.below]) for t, at in ties.items()}
    found, _ = order_statistics(rfm, wanted, dict.fromkeys(wanted, (ends["user_id_min"], ends["user_id_max"])))
    return {t: found[t, t[1] - at.below].value for t, at in ties.items()}


def _bin_of(metric: str, limits: list, parting: dict) -> Column:
    """Bin 1.. of a user's unique rank (value, then id), from its own value and id."""
    above = []
    for k, at in limits:
        if k <= at.below:
            lower = F.col(metric) < at.value
        elif (metric, k) in parting:
            lower = (F.col(metric) < at.value) | ((F.col(metric) == at.value) & (F.col("user_id") <= parting[metric, k]))
        else:
            lower = F.col(metric) <= at.value
        above.append(F.when(lower, 0).otherwise(1))
    return reduce(add, above, F.lit(1))


def score_rfm(rfm: DataFrame, params: RfmParams = _P) -> DataFrame:
    """Adds r/f/m scores (quantile bins of the unique rank; reversed for recency),
    r/f/m levels (median split, ties high) and the segment.  A metric with fewer
    distinct values than bins is scored by the median split.  Rank ties break by
    ascending ``user_id`` (an integer)."""
    rfm, ends = stored_with_bounds(rfm)  # read by the counts, by the selection of ids and by the scoring
    out, q = rfm, params.score_bins
    stats = rfm_stats(rfm, ends, q)
    if not stats:
        for c in SCORE_COLUMNS[:-1]:
            out = out.withColumn(c, F.lit(None).cast("tinyint"))
        return out.withColumn("segment", F.lit(None).cast("string"))
    parting = _parting_ids(rfm, ends, stats)
    for m in METRICS:
        s = SHORT[m]
        if stats[m]["limits"]:
            b = _bin_of(m, stats[m]["limits"], parting)
            score = b if HIGHER_IS_BETTER[m] else F.lit(q + 1) - b
            out = out.withColumn(f"{s}_score", score.cast("tinyint"))
        else:
            out = out.withColumn(f"{s}_score", level_of(m, stats[m]["median"], HIGHER_IS_BETTER[m]))
    for m in METRICS:
        out = out.withColumn(f"{SHORT[m]}_level", level_of(m, stats[m]["median"], HIGHER_IS_BETTER[m]))
    return out.withColumn("segment", segment_of(F.col("r_level"), F.col("f_level"), F.col("m_level")))


def rfm_table(events: DataFrame, params: RfmParams = _P) -> DataFrame:
    """Buy events -> scored and segmented RFM table."""
    return score_rfm(rfm_base(events, params), params).select(*RFM_COLUMNS, *SCORE_COLUMNS)


def rfm_ranks(rfm: DataFrame) -> DataFrame:
    """Unique rank of each metric (ties by ascending user_id), one range sort for all three."""
    return unique_ranks(materialize(rfm.select("user_id", *METRICS)), list(METRICS), "user_id", "_rank")


def rfm_levels(rfm: DataFrame) -> DataFrame:
    """Median-split levels and the medians they used."""
    rfm, ends = stored_with_bounds(rfm)
    stats = rfm_stats(rfm, ends)
    median = {m: stats[m]["median"] if stats else None for m in METRICS}
    return rfm.select(
        "user_id",
        *[level_of(m, median[m], HIGHER_IS_BETTER[m]).alias(f"{SHORT[m]}_level") for m in METRICS],
        *[F.lit(median[m]).cast("double").alias(f"{m}_median") for m in METRICS],
    )


def rfm_summary(scored: DataFrame) -> DataFrame:
    """One row per segment: users, share of users in % (2 places, half-even) and the
    number of distinct buyers (each buyer is in exactly one segment, so it is the sum
    of the per-segment distinct counts)."""
    per = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("user_count"), F.count("user_id").alias("_distinct")  # a row a buyer
    )
    all_rows = Window.partitionBy()  # over at most 8 segment rows
    return per.select(
        "segment",
        F.col("user_count").cast("long").alias("user_count"),
        half_even(F.col("user_count") / F.sum("user_count").over(all_rows) * 100.0, 2).alias("user_ratio"),
        F.sum("_distinct").over(all_rows).cast("long").alias("total_buy_users"),
    )


def rfm_segment_means(scored: DataFrame) -> DataFrame:
    """Mean R, F, M per segment (2 places), sorted by mean frequency descending."""
    return (
        scored.groupBy("segment")
        .agg(*[F.avg(m).alias(f"_{m}") for m in METRICS])
        .orderBy(F.desc("_frequency"), "segment")
        .select("segment", *[half_even(f"_{m}", 2).alias(m) for m in METRICS])
    )


def rfm_kpis(scored: DataFrame) -> DataFrame:
    """Buyers, mean frequency, mean monetary (2 places)."""
    return scored.agg(
        F.count("user_id").cast("long").alias("buy_users"),  # a row a buyer
        half_even(F.avg("frequency"), 2).alias("mean_frequency"),
        half_even(F.avg("monetary"), 2).alias("mean_monetary"),
    )


def rfm_what_if(scored: DataFrame, shift_days: int, params: RfmParams = _P) -> DataFrame:
    """Shift every recency by ``shift_days`` (clipped at 0) and re-score; a shift of 0
    keeps the stored scores."""
    if shift_days == 0:
        return scored
    shifted = scored.withColumn("recency", F.greatest(F.col("recency") + F.lit(shift_days), F.lit(0)).cast("long"))
    return score_rfm(shifted.drop(*SCORE_COLUMNS), params).select(*scored.columns)


def rfm_top_users(scored: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` users by segment ascending, frequency descending (user id breaks ties):
    a top-k, planned as ``TakeOrderedAndProject`` (each task keeps its best n)."""
    return scored.orderBy("segment", F.desc("frequency"), "user_id").limit(n)


def rfm_histogram(scored: DataFrame, max_bins: int = 20, min_bins: int = 3) -> DataFrame:
    """Equal-width histogram of each metric with ``min(max_bins, max(min_bins, distinct))``
    bins on NumPy's edges (last bin closed; a constant column spans value ± 0.5); empty
    bins included.  Rows: ``metric, bin, lower, upper, users``.

    Everything comes from the stored value-count tables: a row a distinct value."""
    spark = scored.sparkSession
    counts = materialize(value_counts(scored), "value_counts")
    rows = counts.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("nd")).collect()
    st = {r["metric"]: r for r in rows}  # three rows
    if not st:
        return spark.createDataFrame([], "metric string, bin int, lower double, upper double, users long")
    spec = {}
    for m in METRICS:
        lo, hi = float(st[m]["lo"]), float(st[m]["hi"])
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        bins = min(max_bins, max(min_bins, int(st[m]["nd"])))
        spec[m] = (lo, hi, bins, (hi - lo) / bins)

    def bin_of(x: Column, lo: float, hi: float, bins: int, step: float) -> Column:
        def edge(i: Column) -> Column:  # NumPy's linspace edge i * step + lo
            return i.cast("double") * F.lit(step) + F.lit(lo)

        idx = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
        idx = F.when(idx >= bins, bins - 1).otherwise(idx)
        idx = F.when(x < edge(idx), idx - 1).otherwise(idx)  # NumPy's correction near edges
        return F.when((x >= edge(idx + 1)) & (idx != bins - 1), idx + 1).otherwise(idx)

    b = None
    for m, (lo, hi, bins, step) in spec.items():
        e = bin_of(F.col("value").cast("double"), lo, hi, bins, step)
        b = F.when(F.col("metric") == m, e) if b is None else b.when(F.col("metric") == m, e)
    counts = counts.select("metric", "n", b.alias("bin")).groupBy("metric", "bin").agg(F.sum("n").alias("users"))
    frame_rows = []
    for m, (lo, hi, bins, step) in spec.items():  # at most 3 x max_bins rows
        for i in range(bins):
            upper = hi if i == bins - 1 else float(i + 1) * step + lo
            frame_rows.append((m, i, float(i) * step + lo, upper))
    frame = spark.createDataFrame(frame_rows, "metric string, bin int, lower double, upper double")
    return (
        frame.join(F.broadcast(counts), ["metric", "bin"], "left")
        .select("metric", "bin", half_even("lower", 6).alias("lower"), half_even("upper", 6).alias("upper"),
                F.coalesce("users", F.lit(0)).cast("long").alias("users"))
        .orderBy("metric", "bin")
    )


def rfm_summary_document(scored: DataFrame) -> dict:
    """The RFM summary document (maps keyed by segment), built from the ≤ 8-row summaries."""
    rows = rfm_summary(scored).collect()
    if not rows:
        return {"total_buy_users": 0, "segment_counts": {}, "segment_ratio": {}, "rfm_mean_by_segment": {}}
    means = {r["segment"]: {m: r[m] for m in METRICS} for r in rfm_segment_means(scored).collect()}
    return {
        "total_buy_users": int(rows[0]["total_buy_users"]),
        "segment_counts": {r["segment"]: int(r["user_count"]) for r in rows},
        "segment_ratio": {r["segment"]: float(r["user_ratio"]) for r in rows},
        "rfm_mean_by_segment": means,
    }


def rfm_document(scored: DataFrame) -> DataFrame:
    """The RFM summary document as a one-row table: ``total_buy_users`` and maps by segment
    (``segment_counts``, ``segment_ratio``, ``rfm_mean_by_segment``); no row without buyers."""
    parts = rfm_summary(scored).join(F.broadcast(rfm_segment_means(scored)), "segment")  # at most 8 rows each
    by = lambda value: F.map_from_entries(F.collect_list(F.struct("segment", value)))
    return parts.groupBy("total_buy_users").agg(
        by(F.col("user_count")).alias("segment_counts"), by(F.col("user_ratio")).alias("segment_ratio"),
        by(F.struct(*METRICS)).alias("rfm_mean_by_segment"))


def load_or_build(spark, path: str, build, refresh: bool = False) -> DataFrame:
    """The stored RFM table at ``path`` if present (and not ``refresh``); otherwise
    ``build()`` is computed, written to ``path`` and read back."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if refresh or not fs.exists(jvm_path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
