"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query proves one or more operators of the inventory on the whole given tables.
Queries that exercise a file format first write the adapted data to a fresh folder
under the shared checkpoint directory, then read it back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace as _replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickscope.functions.numeric import half_even
from clickscope.functions.timefn import local_datetime
from clickscope.operators import clean as C
from clickscope.operators import cluster as CL
from clickscope.operators import funnel as FN
from clickscope.operators import rfm as RF
from clickscope.params import ClusterParams
from clickscope.plans.inputs import EVENTS_CLEAN, ORDERS_RFM, cleaned_events, funnel_input, order_buys, raw_events
from clickscope.schemas import CLEANED, CLEANED_COLUMNS, CLEANING_SUMMARY, CLUSTER_DOCUMENT, FUNNEL_SUMMARY, RFM_DOCUMENT
from clickscope.session import ensure_checkpoint_dir, materialize, shared_path
from clickscope.sources import raw as R
from clickscope.sources import sinks as K
from clickscope.sources import tables as TB
from clickscope.sources.adapters import funnel_events
from clickscope.streaming import clean_stream as STR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RAW_COLS = ["user_id", "item_id", "category_id", "behavior", "timestamp"]
SELECTED_DATES = ("2024-01-06", "2024-01-07", "2024-01-13", "2024-01-14", "2024-01-20", "2024-01-21")


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """The adapted raw log as header-less CSV part files (in line order) in a fresh
    shared folder.  (Tests lower ``maxPartitionBytes`` so that the read splits files.)"""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "raw_csv")
    R.write_raw_csv(raw_events(spark, sf_dir), path)
    return path


# ------------------------------------------------------------------ sources and cleaning


@query("scan_raw")
def q_scan_raw(spark, sf_dir):
    return R.read_raw(spark, _raw_csv(spark, sf_dir))


@query("scan_raw_ordered")
def q_scan_raw_ordered(spark, sf_dir):
    """Keep-first dedup driven by the scan's order key: equals dedup by line order."""
    df = R.read_raw_ordered(spark, _raw_csv(spark, sf_dir))
    return C.dedup_keep_first(df, order_col=R.ORDER_COL).select(*RAW_COLS)


@query("raw_row_count")
def q_raw_row_count(spark, sf_dir):
    return R.raw_row_count(spark, _raw_csv(spark, sf_dir))


@query("local_time")
def q_local_time(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    return C.with_local_time(raw, EVENTS_CLEAN).withColumn(
        "datetime_zone", local_datetime("timestamp", tz_mode="zone", time_zone=EVENTS_CLEAN.time_zone)
    ).select("user_id", "item_id", "timestamp", "ord", "datetime", "datetime_zone", "date", "hour", "weekday")


@query("dedup_keep_first")
def q_dedup(spark, sf_dir):
    return C.dedup_keep_first(raw_events(spark, sf_dir))


@query("filter_behavior")
def q_filter_behavior(spark, sf_dir):
    return C.filter_behavior(raw_events(spark, sf_dir))


@query("filter_date_range")
def q_filter_date_range(spark, sf_dir):
    return C.filter_date_range(raw_events(spark, sf_dir), EVENTS_CLEAN)


@query("coerce_ids")
def q_coerce_ids(spark, sf_dir):
    """The chunked engine's order (dedup, filters) with its id coercion; ``ord`` is
    scaled past the INT range so that oversized values turn into -1."""
    raw = raw_events(spark, sf_dir).withColumn("ord_id", F.col("ord") * F.lit(1_000_000))
    kept = C.filter_behavior(C.dedup_keep_first(raw))
    return C.coerce_ids(kept.select("user_id", "item_id", "category_id", "ord_id", "behavior"),
                        ("user_id", "item_id", "category_id", "ord_id"))


@query("clean_events")
def q_clean_events(spark, sf_dir):
    return cleaned_events(spark, sf_dir)


@query("clean_events_after_filter")
def q_clean_after_filter(spark, sf_dir):
    from dataclasses import replace
    return cleaned_events(spark, sf_dir, replace(EVENTS_CLEAN, dedup_scope="after_filter"))


def _stored_ids(spark, sf_dir) -> DataFrame:
    """The cleaned events' columns of an overview, stored (the counts read it once a column)."""
    return materialize(cleaned_events(spark, sf_dir).select("user_id", "item_id", "category_id", "datetime", "date"), "cleaned_ids")


@query("cleaning_overview")
def q_cleaning_overview(spark, sf_dir):
    return C.cleaning_overview(_stored_ids(spark, sf_dir))


@query("cleaning_overview_by_day")
def q_cleaning_overview_by_day(spark, sf_dir):
    """Each day's overview from its partials (counts and bitmaps)."""
    days = ("date",)
    return C.overview_of_partials(*C.overview_partials(_stored_ids(spark, sf_dir), days), days)


@query("cleaning_overview_merged")
def q_cleaning_overview_merged(spark, sf_dir):
    """The overview from stored day partials of two loads, merged without the log."""
    stored = _stored_ids(spark, sf_dir)
    odd = F.substring("date", 10, 1).cast("int") % 2 == 1
    loads = [C.overview_partials(stored.where(part)) for part in (odd, ~odd)]
    rows, ids = ([materialize(load[i], "overview_partials") for load in loads] for i in (0, 1))
    return C.overview_of_partials(rows[0].unionByName(rows[1]), ids[0].unionByName(ids[1]))


@query("behavior_counts")
def q_behavior_counts(spark, sf_dir):
    return C.behavior_counts(cleaned_events(spark, sf_dir))


@query("cleaning_audit")
def q_cleaning_audit(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    return C.cleaning_audit(raw, C.clean_events(raw, EVENTS_CLEAN), EVENTS_CLEAN)


@query("cleaning_stage_counts")
def q_cleaning_stage_counts(spark, sf_dir):
    return C.cleaning_stage_counts(raw_events(spark, sf_dir), EVENTS_CLEAN)


@query("overview")
def q_overview(spark, sf_dir):
    return C.overview(_stored_ids(spark, sf_dir))


def _written_cleaned(spark, sf_dir, partition_by_date=False) -> str:
    path = shared_path(spark, "cleaned")
    K.write_cleaned(cleaned_events(spark, sf_dir), path, partition_by_date=partition_by_date)
    return path


@query("roundtrip_cleaned")
def q_roundtrip(spark, sf_dir):
    return TB.scan_cleaned(spark, _written_cleaned(spark, sf_dir)).select(*CLEANED_COLUMNS)


@query("scan_cleaned")
def q_scan_cleaned(spark, sf_dir):
    """Date-partitioned dataset read back with the declared schema (``date`` stays a string)."""
    path = _written_cleaned(spark, sf_dir, partition_by_date=True)
    return TB.scan_cleaned(spark, path).select(*CLEANED_COLUMNS)


@query("load_cleaned")
def q_load_cleaned(spark, sf_dir):
    path = _written_cleaned(spark, sf_dir)
    return TB.load_cleaned(spark, path, ["user_id", "item_id", "category_id", "behavior", "datetime"])


LOADED = ["user_id", "item_id", "category_id", "behavior", "datetime"]


@query("load_cleaned_csv")
def q_load_cleaned_csv(spark, sf_dir):
    """Cleaned events stored as CSV come back with their types."""
    path = shared_path(spark, "cleaned_csv")
    cleaned_events(spark, sf_dir).write.option("header", "true").csv(path)
    return TB.load_cleaned(spark, path, LOADED, fmt="csv")


@query("load_cleaned_by_date")
def q_load_cleaned_by_date(spark, sf_dir):
    """Cleaned events in date folders; ``date`` comes from the folder, as a string."""
    path = _written_cleaned(spark, sf_dir, partition_by_date=True)
    return TB.load_cleaned(spark, path, [*LOADED, "date"])


@query("load_cleaned_parts")
def q_load_cleaned_parts(spark, sf_dir):
    """A folder of Parquet and CSV parts, as loads leave them."""
    stored = materialize(cleaned_events(spark, sf_dir))
    base = shared_path(spark, "cleaned_parts")
    weekend = F.col("weekday") >= 5
    stored.where(~weekend).write.parquet(f"{base}/part_0001.parquet")
    stored.where(weekend).write.option("header", "true").csv(f"{base}/part_0002.csv")
    return TB.load_cleaned(spark, base, LOADED, fmt="parts")


@query("read_table")
def q_read_table(spark, sf_dir):
    """A directory holding a Parquet part (pv, fav) and a CSV part (cart, buy)."""
    cleaned = cleaned_events(spark, sf_dir)
    base = shared_path(spark, "table_dir")
    cleaned.filter(F.col("behavior").isin("pv", "fav")).write.mode("overwrite").parquet(f"{base}/part_0001.parquet")
    (cleaned.filter(F.col("behavior").isin("cart", "buy")).write.mode("overwrite")
     .option("header", "true").csv(f"{base}/part_0002.csv"))
    return TB.read_table(spark, base, schema=CLEANED).select(*CLEANED_COLUMNS)


# ------------------------------------------------------------------ funnel


@query("first_touch")
def q_first_touch(spark, sf_dir):
    return FN.first_touch(funnel_input(spark, sf_dir))


@query("funnel_step_join")
def q_funnel_step_join(spark, sf_dir):
    ev = funnel_input(spark, sf_dir)
    first = ev.filter(F.col("behavior") == "pv").groupBy("user_id").agg(F.min("timestamp").alias("previous_time"))
    return FN.funnel_step(ev, first, "fav", out_col="fav_time")


@query("funnel")
def q_funnel(spark, sf_dir):
    return FN.ordered_funnel(funnel_input(spark, sf_dir))


@query("funnel_users")
def q_funnel_users(spark, sf_dir):
    """The ordered funnel of the log's own users."""
    return FN.ordered_funnel(materialize(cleaned_events(spark, sf_dir).select("user_id", "behavior", "timestamp")))


@query("daily_conversion")
def q_daily(spark, sf_dir):
    return FN.daily_conversion(cleaned_events(spark, sf_dir))


@query("hourly_conversion")
def q_hourly(spark, sf_dir):
    return FN.hourly_conversion(cleaned_events(spark, sf_dir))


@query("daily_selected")
def q_daily_selected(spark, sf_dir):
    return FN.select_dates(FN.daily_conversion(cleaned_events(spark, sf_dir)), SELECTED_DATES)


@query("funnel_flows")
def q_funnel_flows(spark, sf_dir):
    return FN.funnel_flows(FN.ordered_funnel(funnel_input(spark, sf_dir)))


@query("funnel_overall")
def q_funnel_overall(spark, sf_dir):
    return FN.funnel_overall(FN.ordered_funnel(funnel_input(spark, sf_dir)))


def _funnel_doc(spark, sf_dir) -> DataFrame:
    """Funnel, daily and hourly tables from one materialized cleaned table."""
    cleaned = materialize(cleaned_events(spark, sf_dir))
    return FN.funnel_summary(
        FN.ordered_funnel(funnel_events(cleaned)), FN.daily_conversion(cleaned), FN.hourly_conversion(cleaned)
    )


@query("funnel_summary")
def q_funnel_summary(spark, sf_dir):
    return FN.funnel_summary_flat(_funnel_doc(spark, sf_dir))


@query("summary_roundtrip")
def q_summary_roundtrip(spark, sf_dir):
    """The funnel summary written as a JSON document and read back with its schema."""
    path = shared_path(spark, "funnel_summary_json")
    K.write_summary_json(_funnel_doc(spark, sf_dir), path)
    return FN.explode_funnel(K.read_summary_json(spark, path, FUNNEL_SUMMARY))


# ------------------------------------------------------------------ RFM


# the adapted event log ends 2024-01-25 (local); its reference instant is the next midnight
EVENTS_RFM = _replace(ORDERS_RFM, analysis_end="2024-01-26")
WHAT_IF_SHIFT = -2


def _scored_orders(spark, sf_dir, status=None, params=ORDERS_RFM) -> DataFrame:
    return RF.rfm_table(order_buys(spark, sf_dir, status), params)


@query("buy_events")
def q_buy_events(spark, sf_dir):
    return RF.buy_events(cleaned_events(spark, sf_dir)).select("user_id", "item_id", "category_id", "behavior", "datetime")


@query("rfm_table")
def q_rfm_table(spark, sf_dir):
    return _scored_orders(spark, sf_dir)


@query("rfm_events")
def q_rfm_events(spark, sf_dir):
    """RFM over the cleaned click log itself (the pipeline's own input)."""
    return RF.rfm_table(cleaned_events(spark, sf_dir), EVENTS_RFM)


@query("rfm_table_freq_mode")
def q_rfm_freq_mode(spark, sf_dir):
    return _scored_orders(spark, sf_dir, params=_replace(ORDERS_RFM, monetary_mode="frequency"))


@query("rfm_rank")
def q_rfm_rank(spark, sf_dir):
    return RF.rfm_ranks(RF.rfm_base(order_buys(spark, sf_dir), ORDERS_RFM))


@query("rfm_scores")
def q_rfm_scores(spark, sf_dir):
    return _scored_orders(spark, sf_dir).select("user_id", "r_score", "f_score", "m_score")


@query("rfm_scores_status_f")
def q_rfm_scores_f(spark, sf_dir):
    """Buyers of finished orders (n mod 3 = 1 at sf0.01)."""
    return _scored_orders(spark, sf_dir, "F").select("user_id", "r_score", "f_score", "m_score")


@query("rfm_scores_status_o")
def q_rfm_scores_o(spark, sf_dir):
    """Buyers of open orders (n mod 3 = 2 at sf0.01)."""
    return _scored_orders(spark, sf_dir, "O").select("user_id", "r_score", "f_score", "m_score")


@query("rfm_levels")
def q_rfm_levels(spark, sf_dir):
    return RF.rfm_levels(RF.rfm_base(order_buys(spark, sf_dir), ORDERS_RFM))


@query("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return _scored_orders(spark, sf_dir).select("user_id", "r_level", "f_level", "m_level", "segment")


@query("rfm_summary")
def q_rfm_summary(spark, sf_dir):
    return RF.rfm_summary(_scored_orders(spark, sf_dir))


@query("rfm_document")
def q_rfm_document(spark, sf_dir):
    """The RFM summary document written as JSON and read back; one row per segment."""
    path = shared_path(spark, "rfm_document_json")
    K.write_summary_json(RF.rfm_document(_scored_orders(spark, sf_dir)), path)
    back = K.read_summary_json(spark, path, RFM_DOCUMENT)
    rows = back.select("total_buy_users", "segment_ratio", "rfm_mean_by_segment", F.explode("segment_counts").alias("segment", "user_count"))
    return rows.select("total_buy_users", "segment", "user_count", F.col("segment_ratio")[F.col("segment")].alias("user_ratio"),
                       *[F.col("rfm_mean_by_segment")[F.col("segment")][m].alias(m) for m in RF.METRICS])


@query("rfm_segment_means")
def q_rfm_segment_means(spark, sf_dir):
    return RF.rfm_segment_means(_scored_orders(spark, sf_dir))


@query("rfm_histogram")
def q_rfm_histogram(spark, sf_dir):
    return RF.rfm_histogram(_scored_orders(spark, sf_dir))


@query("rfm_kpis")
def q_rfm_kpis(spark, sf_dir):
    return RF.rfm_kpis(_scored_orders(spark, sf_dir))


@query("rfm_what_if")
def q_rfm_what_if(spark, sf_dir):
    return RF.rfm_summary(RF.rfm_what_if(_scored_orders(spark, sf_dir), WHAT_IF_SHIFT, ORDERS_RFM))


@query("rfm_top_users")
def q_rfm_top_users(spark, sf_dir):
    return RF.rfm_top_users(_scored_orders(spark, sf_dir)).select(
        "user_id", "segment", "recency", "frequency", "monetary", "r_score", "f_score", "m_score"
    )


# ------------------------------------------------------------------ clustering


CLUSTER = ClusterParams()
RECLUSTER_K = 3
SAMPLE_ROWS = 100  # fewer than the buyers of any given table


def _level_labelled(spark, sf_dir) -> DataFrame:
    return CL.with_labels(CL.level_clusters(_scored_orders(spark, sf_dir)))


@query("cluster_features")
def q_cluster_features(spark, sf_dir):
    feats = CL.standardize(_scored_orders(spark, sf_dir), CLUSTER)
    return feats.select("user_id", *CL.METRICS, *CL.z_columns(feats))


@query("cluster_labels")
def q_cluster_labels(spark, sf_dir):
    return _level_labelled(spark, sf_dir)


@query("cluster_summary")
def q_cluster_summary(spark, sf_dir):
    return CL.cluster_summary(_level_labelled(spark, sf_dir))


@query("cluster_document")
def q_cluster_document(spark, sf_dir):
    """The clustering document of the level clusters, written as JSON and read back; one row a
    cluster.  Its elbow has the one k of that clustering."""
    labelled = _level_labelled(spark, sf_dir)
    path = shared_path(spark, "clustering_summary_json")
    K.write_summary_json(CL.cluster_document(labelled, CL.assignment_inertia(labelled), CLUSTER.k), path)
    back = K.read_summary_json(spark, path, CLUSTER_DOCUMENT)
    return back.select("cluster_count", "selected_k", F.explode("clusters").alias("c"), F.col("elbow")[0].alias("e")).select(
        "cluster_count", "selected_k", "c.*", F.col("e.k").alias("elbow_k"), F.round("e.inertia", 3).alias("elbow_inertia"))


@query("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    return CL.cluster_profile(_level_labelled(spark, sf_dir))


@query("cluster_label_share")
def q_cluster_label_share(spark, sf_dir):
    return CL.cluster_label_share(_level_labelled(spark, sf_dir))


@query("cluster_elbow")
def q_cluster_elbow(spark, sf_dir):
    triples, stats = CL.feature_triples(_scored_orders(spark, sf_dir), CLUSTER)
    return CL.elbow(triples, stats, CLUSTER)


@query("cluster_certificate")
def q_cluster_certificate(spark, sf_dir):
    """Proof of the fits for k = 2..8, run to their fixed points."""
    exact = _replace(CLUSTER, tol=0.0)
    return CL.kmeans_certificate(*CL.feature_triples(_scored_orders(spark, sf_dir), exact), exact)


@query("cluster_assign")
def q_cluster_assign(spark, sf_dir):
    labelled, _, _ = CL.clustering_run(_scored_orders(spark, sf_dir), CLUSTER, with_elbow=False)
    return labelled


@query("cluster_recluster")
def q_cluster_recluster(spark, sf_dir):
    """Re-cluster the stored users at another k and summarize."""
    labelled, _, _ = CL.clustering_run(_scored_orders(spark, sf_dir), CLUSTER, k=RECLUSTER_K, with_elbow=False)
    return CL.cluster_summary(labelled)


@query("cluster_sample")
def q_cluster_sample(spark, sf_dir):
    """A sample smaller than the table, with its features."""
    scored = _scored_orders(spark, sf_dir)
    feats = CL.standardize(scored, CLUSTER)
    return CL.seeded_sample(feats, SAMPLE_ROWS, CLUSTER.seed).select("user_id", *CL.METRICS, *CL.z_columns(feats))


@query("cluster_pca")
def q_cluster_pca(spark, sf_dir):
    """PCA of the standardized features of all users."""
    scored = _scored_orders(spark, sf_dir)
    stats = CL.feature_stats(scored, CLUSTER)
    done = CL.pca_coordinates(CL.standardize(scored, CLUSTER, stats), stats, CLUSTER)
    return done.select("user_id", *CL.METRICS, *[half_even(f"pca_{i}", 6).alias(f"pca_{i}") for i in (1, 2)])


# ------------------------------------------------------------------ streams


def _arrival_batch(raw: DataFrame) -> DataFrame:
    """``raw`` plus ``arrival`` (0..3): the first 40% of events, the next 40% with the
    copies of the first half, the last 20%, the remaining copies.  Of every 17 events one
    arrives late, with the last 20%, and its copy after it: weeks behind the newest row
    before it.  Every raw row arrives exactly once."""
    n = raw.agg(F.max(F.floor(F.col("ord") / 2))).first()[0] + 1
    eid = F.floor(F.col("ord") / 2)
    orig = (F.col("ord") % 2) == 0
    late = eid % 17 == 0
    arrival = (
        F.when(orig & late, 2)
        .when(late, 3)
        .when(orig & (eid < 0.4 * n), 0)
        .when(orig & (eid < 0.8 * n), 1)
        .when(orig, 2)
        .when(eid < 0.5 * n, 1)
        .otherwise(3)
    )
    return raw.withColumn("arrival_batch", arrival)


def _arrival_batches(raw: DataFrame) -> list[DataFrame]:
    tagged = _arrival_batch(raw)
    return [tagged.filter(F.col("arrival_batch") == i).drop("arrival_batch") for i in range(4)]


STATE_ROWS_PER_PARTITION = 1_000_000


def _state_partitions(spark, rows: int) -> int:
    """State partitions sized by the rows (about a million per partition, at most the
    shuffle-partition setting)."""
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(cap, -(-rows // STATE_ROWS_PER_PARTITION)))


def _run_stream_clean(spark, sf_dir, dedup="unbounded") -> tuple[str, int]:
    base = shared_path(spark, "stream")
    inp, out = f"{base}/input", f"{base}/clean"
    files = STR.feed_batches(spark, _arrival_batch(raw_events(spark, sf_dir)), "arrival_batch", inp)
    parts = _state_partitions(spark, len(files) * STR.FEED_ROWS_PER_FILE // 4)
    q = STR.stream_clean(spark, inp, out, f"{base}/ckpt_clean", EVENTS_CLEAN, dedup=dedup, state_partitions=parts)
    q.awaitTermination()
    return out, parts


@query("stream_clean")
def q_stream_clean(spark, sf_dir):
    out, _ = _run_stream_clean(spark, sf_dir)
    return spark.read.schema(CLEANED).parquet(out).select(*CLEANED_COLUMNS)


@query("stream_clean_unbounded")
def q_stream_clean_unbounded(spark, sf_dir):
    out, _ = _run_stream_clean(spark, sf_dir, dedup="unbounded")
    return spark.read.schema(CLEANED).parquet(out).select(*CLEANED_COLUMNS)


@query("stream_counts")
def q_stream_counts(spark, sf_dir):
    clean_dir, parts = _run_stream_clean(spark, sf_dir)
    base = shared_path(spark, "stream_counts")
    q = STR.stream_counts(spark, clean_dir, f"{base}/table", f"{base}/ckpt", state_partitions=parts)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table").select("behavior", "rows", "min_datetime", "max_datetime")


# ------------------------------------------------------------------ stored tables, batches, documents


@query("rfm_stored")
def q_rfm_stored(spark, sf_dir):
    """Build and store the RFM table, then reuse the stored one (second call reads it)."""
    path = shared_path(spark, "rfm_result")
    RF.load_or_build(spark, path, lambda: _scored_orders(spark, sf_dir))
    return RF.load_or_build(spark, path, lambda: _scored_orders(spark, sf_dir))


@query("load_cleaned_batches")
def q_load_cleaned_batches(spark, sf_dir):
    """Rows per behavior over the cleaned data's partitions, partial counts merged."""
    cleaned = TB.load_cleaned(spark, _written_cleaned(spark, sf_dir), ["behavior"])
    return cleaned.groupBy("behavior").agg(F.count(F.lit(1)).alias("rows"))


@query("compacted_cleaned")
def q_compacted(spark, sf_dir):
    """Write in files of AQE's advisory size, with an observed row count."""
    path, _ = K.write_compacted(cleaned_events(spark, sf_dir), shared_path(spark, "compact"))
    return spark.read.parquet(path).select(*CLEANED_COLUMNS)


def _cleaning_document(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """The cleaning summary, written as JSON and read back."""
    doc = C.cleaning_summary(raw, materialize(C.clean_events(raw, EVENTS_CLEAN)), EVENTS_CLEAN)
    path = shared_path(spark, "cleaning_summary_json")
    K.write_summary_json(doc, path)
    return K.read_summary_json(spark, path, CLEANING_SUMMARY)


@query("overview_stored")
def q_overview_stored(spark, sf_dir):
    """Dashboard KPIs from the stored cleaning summary document."""
    return C.overview_of_summary(_cleaning_document(spark, raw_events(spark, sf_dir)))


@query("cleaning_summary_roundtrip")
def q_cleaning_summary(spark, sf_dir):
    """The cleaning summary document (behavior map, date-range struct) written as JSON and
    read back with its schema; one row per behavior."""
    raw = raw_events(spark, sf_dir)
    return _cleaning_document(spark, raw).select(
        "raw_rows", "final_rows", "user_count", "item_count", "category_count", "total_removed_rows",
        F.col("date_range.start").alias("start"), F.col("date_range.end").alias("end"),
        F.explode("behavior_counts").alias("behavior", "rows"),
    )


@query("stream_clean_ordered")
def q_stream_clean_ordered(spark, sf_dir):
    """Exact keep-first inside and across micro-batches (foreachBatch + seen-key table).
    Arrival batches hold several files each, so duplicates meet inside one micro-batch."""
    base = shared_path(spark, "stream_ordered")
    inp, out = f"{base}/input", f"{base}/clean"
    files = STR.feed_batches(spark, _arrival_batch(raw_events(spark, sf_dir)), "arrival_batch", inp)
    q = STR.stream_clean_ordered(spark, inp, out, f"{base}/ckpt", EVENTS_CLEAN, max_files_per_trigger=2,
                                 bucket_seconds=86400,
                                 state_partitions=_state_partitions(spark, len(files) * STR.FEED_ROWS_PER_FILE // 4))
    q.awaitTermination()
    return spark.read.schema(CLEANED).parquet(out).select(*CLEANED_COLUMNS)
