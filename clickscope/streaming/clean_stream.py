"""Incremental clean of arriving raw CSV files, and running counts over its output.

``stream_clean``: ``readStream`` CSV with the declared schema -> keep-first dedup
across micro-batches (**before** the behavior and date filters, as in the batch job)
-> the batch job's filters, local time and casts -> Parquet sink with a checkpoint.

Dedup state lives in the state store, partitioned by key:
* ``dedup="unbounded"`` (default): ``dropDuplicates`` keeps every key forever (exact, like an
  ever-growing seen-set).
* ``dedup="watermark"``: ``dropDuplicatesWithinWatermark`` on event time
  ``timestamp_seconds(timestamp)``; state is bounded by the delay, rows later than the
  delay are dropped.

Inside one micro-batch the state store keeps the first row it *processes*; with one
file per trigger and files of one split (``feed_files``) that is the first line, as in
batch.  ``stream_clean_ordered`` is exact without that contract: keep-first by line
order inside each micro-batch, then a left-anti join against the keys of earlier epochs.
Those are stored in runs, merged by levels as epochs pass (``merge_runs``): the number of runs
grows with the logarithm of the epochs, and a key is rewritten once a level.

``stream_counts``: a second stream over the clean sink, ``groupBy(behavior)`` with
count / min / max datetime in complete mode; each epoch's table (one row per behavior)
replaces the previous one through ``foreachBatch``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickscope.operators.clean import clean_after_dedup
from clickscope.params import CleanParams
from clickscope.schemas import CLEANED, RAW

_P = CleanParams()


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Dedup state grows with the key count: keep it in RocksDB (off-heap, spilling to
    local disk, snapshotted to the checkpoint location) instead of the JVM heap, unless
    the user chose a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ROCKSDB_PROVIDER)


def _start(spark: SparkSession, writer, state_partitions: int | None) -> StreamingQuery:
    """Start ``writer``; ``state_partitions`` sets the number of state / shuffle partitions
    the query keeps for its life (fixed at the first start), without changing the
    session's setting for other work."""
    if state_partitions is None:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def raw_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(RAW)
        .option("header", "false")
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
        .csv(input_dir)
    )


def stream_clean(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                 params: CleanParams = _P, dedup: str = "unbounded", watermark_delay: str = "7 days",
                 max_files_per_trigger: int = 1, available_now: bool = True,
                 state_partitions: int | None = None) -> StreamingQuery:
    """Start the incremental clean; returns the running query.

    ``dedup="unbounded"`` (default) keeps every key seen: no row is lost, however late, and
    state grows with the distinct keys (RocksDB).  ``"watermark"``, on request only, drops
    rows that come more than ``watermark_delay`` behind the newest one and forgets their
    keys: bounded state, incomplete output; the query's progress reports the number in
    ``numRowsDroppedByWatermark``."""
    use_rocksdb_state(spark)
    src = raw_stream(spark, input_dir, max_files_per_trigger)
    key = list(params.dedup_key)
    if dedup == "watermark":
        deduped = (
            src.withColumn("_event_time", F.timestamp_seconds("timestamp"))
            .withWatermark("_event_time", watermark_delay)
            .dropDuplicatesWithinWatermark(key)
            .drop("_event_time")
        )
    elif dedup == "unbounded":
        deduped = src.dropDuplicates(key)
    else:
        raise ValueError(f"unknown dedup {dedup!r}")
    cleaned = clean_after_dedup(deduped, params)
    writer = (
        cleaned.writeStream.format("parquet")
        .option("path", output_dir)
        .option("checkpointLocation", checkpoint_dir)
        .option("compression", "zstd")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return _start(spark, writer, state_partitions)


SEEN_BUCKET_SECONDS = 3600
RUN_FAN_IN = 8  # runs of a level that become one of the next


def _run_name(first: int, last: int) -> str:
    return f"run_{first:010d}_{last:010d}"


def seen_runs(spark: SparkSession, seen_dir: str) -> list[tuple[int, int, str]]:
    """``(first epoch, last epoch, path)`` of the complete runs of seen keys, without those that
    a merged run covers; a listing of folders, not of rows."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        path = status.getPath()
        parts = path.getName().split("_")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if parts[0] == "run" and fs.exists(done):
            found.append((int(parts[1]), int(parts[2]), str(path.toString())))
    return sorted(r for r in found if not any(o[0] <= r[0] and r[1] <= o[1] and o != r for o in found))


def _read_keys(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    return reduce(DataFrame.unionAll, [spark.read.schema(schema).parquet(p) for p in paths])


def _write_keys(keys: DataFrame, path: str) -> None:
    """A run: one folder a bucket, in files of AQE's advisory size."""
    keys.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def merge_runs(spark: SparkSession, seen_dir: str, schema: T.StructType, epoch_id: int, fan_in: int = RUN_FAN_IN) -> None:
    """Before ``epoch_id``: if a level is full, its ``fan_in`` runs (of the epochs just before)
    become one of the next level, and so on.

    Which epochs merge follows from ``epoch_id`` alone, only finished epochs do, and the old runs
    go after the merged one is complete: a retry does the same or finds it done, and until
    then the old ones are read."""
    fs = None
    width = fan_in
    while epoch_id and epoch_id % width == 0:
        first, last = epoch_id - width, epoch_id - 1
        runs = seen_runs(spark, seen_dir)
        inside = [r for r in runs if first <= r[0] and r[1] <= last]
        if len(inside) > 1:
            _write_keys(_read_keys(spark, schema, [r[2] for r in inside]), f"{seen_dir}/{_run_name(first, last)}")
            for _, _, old in inside:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
                fs = fs or path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(path, True)
        width *= fan_in


def stream_clean_ordered(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                         params: CleanParams = _P, max_files_per_trigger: int = 1,
                         available_now: bool = True, bucket_seconds: int = SEEN_BUCKET_SECONDS,
                         state_partitions: int | None = None, fan_in: int = RUN_FAN_IN) -> StreamingQuery:
    """Exact keep-first across *and inside* micro-batches, through ``foreachBatch``.

    Per epoch: (1) keep-first inside the batch by line order (file path, split start,
    row) - the batch job's distributed window; (2) drop keys already seen in earlier
    epochs with a left-anti join against the runs in ``<checkpoint_dir>/seen``, each
    partitioned by ``bucket_seconds`` buckets of ``timestamp`` (duplicates share their
    timestamp, so only the buckets from the batch's least to its greatest are read); (3) write the cleaned rows
    under ``epoch=<id>`` and the new keys as a run, replacing any earlier attempt of the same
    epoch, so a retried epoch is idempotent.  Runs are merged by levels of ``fan_in``.  Output: ``output_dir/epoch=*/`` Parquet.

    Cost: each epoch joins against the seen keys of its buckets, where the state-store
    form does point lookups; use this form when the in-batch winner must be the first
    line, the state-store form for throughput."""
    from clickscope.operators.clean import dedup_keep_first

    key = list(params.dedup_key)
    seen_dir = f"{checkpoint_dir.rstrip('/')}/seen"
    src = raw_stream(spark, input_dir, max_files_per_trigger).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )

    kinds = {f.name: f.dataType for f in RAW.fields}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in key], T.StructField("_bucket", T.LongType())])

    def process(batch: DataFrame, epoch_id: int) -> None:
        merge_runs(spark, seen_dir, schema, epoch_id, fan_in)
        ordered = batch.withColumn(
            "_ord", F.struct("_file", "_block", F.monotonically_increasing_id().alias("_row"))
        ).withColumn("_bucket", F.floor(F.col("timestamp") / bucket_seconds).cast("long"))
        winners = dedup_keep_first(ordered, key, "_ord").drop("_file", "_block", "_ord").persist()
        try:
            low, high = winners.agg(F.min("_bucket"), F.max("_bucket")).first()
            fresh = winners
            earlier = [path for _, last, path in seen_runs(spark, seen_dir) if last < epoch_id]
            if earlier:
                touched = F.col("_bucket").isNull() | F.col("_bucket").between(F.lit(low), F.lit(high))
                seen = _read_keys(spark, schema, earlier).filter(touched).select(*[F.col(k).alias(f"_seen_{k}") for k in key])
                # nulls are equal, as in the batch job's window
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in key])
                fresh = winners.join(seen, same, "left_anti")
            fresh = fresh.persist()
            _write_keys(fresh.select(*key, "_bucket"), f"{seen_dir}/{_run_name(epoch_id, epoch_id)}")
            clean_after_dedup(fresh.drop("_bucket"), params).write.mode("overwrite").option(
                "compression", "zstd").parquet(f"{output_dir.rstrip('/')}/epoch={epoch_id}")
            fresh.unpersist()
        finally:
            winners.unpersist()

    writer = src.writeStream.option("checkpointLocation", f"{checkpoint_dir.rstrip('/')}/stream").foreachBatch(
        process)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return _start(spark, writer, state_partitions)


def stream_counts(spark: SparkSession, clean_dir: str, output_dir: str, checkpoint_dir: str,
                  available_now: bool = True, state_partitions: int | None = None) -> StreamingQuery:
    """Running ``behavior, rows, min_datetime, max_datetime`` over the clean sink."""
    use_rocksdb_state(spark)
    src = spark.readStream.schema(CLEANED).parquet(clean_dir)
    agg = src.groupBy("behavior").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("datetime").alias("min_datetime"),
        F.max("datetime").alias("max_datetime"),
    )

    def replace_table(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(output_dir)

    writer = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir).foreachBatch(
        replace_table
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return _start(spark, writer, state_partitions)


FEED_ROWS_PER_FILE = 1_000_000


def feed_batches(spark: SparkSession, raw: DataFrame, batch_col: str, input_dir: str, order_col: str = "ord",
                 base_mtime_ms: int | None = None, rows_per_file: int = FEED_ROWS_PER_FILE) -> list[str]:
    """Write ``raw`` as header-less CSV files into ``input_dir``, one arrival batch per
    value of ``batch_col`` (0, 1, ...): one aggregate counts every batch, one
    range-partitioned write (on batch, then ``order_col``) produces files of at most about
    ``rows_per_file`` rows, sorted inside.  The files get strictly rising modification
    times in (batch, range) order, so the file source takes them in line order.  No batch
    passes through a single task."""
    import time

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(input_dir)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    counts = {r[0]: r[1] for r in raw.groupBy(batch_col).count().collect()}  # one row per batch
    if not counts:
        return []
    parts = sum(max(1, -(-n // rows_per_file)) for n in counts.values())
    tmp = f"{input_dir.rstrip('/')}_staging"
    cols = [f.name for f in RAW.fields]
    (raw.select(*cols, order_col, F.col(batch_col).alias("arrival"))
     .repartitionByRange(parts, "arrival", order_col)
     .sortWithinPartitions("arrival", order_col)
     .drop(order_col)
     .write.mode("overwrite").option("header", "false").partitionBy("arrival").csv(tmp))
    base = base_mtime_ms or int(time.time() * 1000) - 3_600_000
    written, tick = [], 0
    for b in sorted(counts):
        bdir = jvm.org.apache.hadoop.fs.Path(f"{tmp}/arrival={b}")
        names = sorted(st.getPath().getName() for st in fs.listStatus(bdir)
                       if st.getPath().getName().startswith("part-"))
        for name in names:  # part numbers follow the ranges
            dst = jvm.org.apache.hadoop.fs.Path(f"{input_dir.rstrip('/')}/batch_{b:04d}_{name}")
            fs.rename(jvm.org.apache.hadoop.fs.Path(f"{tmp}/arrival={b}/{name}"), dst)
            fs.setTimes(dst, base + tick * 10_000, -1)
            tick += 1
            written.append(str(dst))
    return written


def feed_files(spark: SparkSession, batches: list[DataFrame], input_dir: str, order_col: str = "ord",
               base_mtime_ms: int | None = None, rows_per_file: int = FEED_ROWS_PER_FILE) -> list[str]:
    """``feed_batches`` for a list of frames (frame i is arrival batch i)."""
    tagged = None
    for i, b in enumerate(batches):
        t = b.withColumn("_arrival", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    if tagged is None:
        return []
    return feed_batches(spark, tagged, "_arrival", input_dir, order_col, base_mtime_ms, rows_per_file)
