"""Stream clean equals the batch clean when files arrive in order."""

from clickscope.operators import clean as C
from clickscope.plans.catalog import _arrival_batches
from clickscope.plans.inputs import EVENTS_CLEAN, raw_events
from clickscope.schemas import CLEANED
from clickscope.session import shared_path
from clickscope.streaming import feed_files, stream_clean, stream_counts

from conftest import SF001


def test_stream_equals_batch(spark):
    raw = raw_events(spark, SF001)
    base = shared_path(spark, "test_stream")
    feed_files(spark, _arrival_batches(raw), f"{base}/in")
    out = f"{base}/out"  # some originals come weeks late
    stream_clean(spark, f"{base}/in", out, f"{base}/ck", EVENTS_CLEAN).awaitTermination()
    got = spark.read.schema(CLEANED).parquet(out).collect()
    assert sorted(got) == sorted(C.clean_events(raw, EVENTS_CLEAN).collect())
    stream_counts(spark, out, f"{base}/counts", f"{base}/ck_counts").awaitTermination()
    counts = {r.behavior: r.rows for r in spark.read.parquet(f"{base}/counts").collect()}
    assert counts == {"pv": 146, "fav": 162, "cart": 156, "buy": 160}


def test_ordered_stream_is_exact_with_everything_in_one_batch(spark):
    from clickscope.streaming import stream_clean_ordered

    raw = raw_events(spark, SF001)
    base = shared_path(spark, "test_stream_ordered")
    feed_files(spark, _arrival_batches(raw), f"{base}/in", rows_per_file=100)
    stream_clean_ordered(spark, f"{base}/in", f"{base}/out", f"{base}/ck", EVENTS_CLEAN,
                         max_files_per_trigger=1000, bucket_seconds=86400).awaitTermination()
    got = spark.read.schema(CLEANED).parquet(f"{base}/out").select(*[f.name for f in CLEANED.fields]).collect()
    assert sorted(got) == sorted(C.clean_events(raw, EVENTS_CLEAN).collect())


def test_ordered_stream_knows_null_keys_of_earlier_epochs(spark):
    from clickscope.schemas import RAW
    from clickscope.streaming import stream_clean_ordered

    base = shared_path(spark, "test_stream_nulls")
    row = (None, 7, 8, "pv", 1704500000)
    for name in ("a", "b"):
        spark.createDataFrame([row, (1 if name == "a" else 2, 7, 8, "buy", 1704500000)], RAW).coalesce(1).write.csv(f"{base}/part_{name}")
    import time
    src = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    src.mkdirs(path(f"{base}/in"))
    for name in ("a", "b"):
        part = next(str(f.getPath().toString()) for f in src.listStatus(path(f"{base}/part_{name}")) if "part-" in f.getPath().getName() and f.getPath().getName().endswith("csv"))
        src.rename(path(part), path(f"{base}/in/{name}.csv"))
        time.sleep(0.01)
    stream_clean_ordered(spark, f"{base}/in", f"{base}/out", f"{base}/ck", EVENTS_CLEAN, max_files_per_trigger=1).awaitTermination()
    got = spark.read.schema(CLEANED).parquet(f"{base}/out").collect()
    assert sorted(r.user_id if r.user_id is not None else -1 for r in got) == [-1, 1, 2]


def test_runs_of_seen_keys_merge_and_lose_nothing(spark):
    """Many epochs, small levels: few runs are left, each key is known, a retry changes nothing."""
    from clickscope.schemas import RAW
    from clickscope.streaming.clean_stream import merge_runs, seen_runs, stream_clean_ordered
    from pyspark.sql import types as T

    raw = raw_events(spark, SF001)
    base = shared_path(spark, "test_stream_runs")
    files = feed_files(spark, _arrival_batches(raw), f"{base}/in", rows_per_file=130)
    assert len(files) >= 8
    stream_clean_ordered(spark, f"{base}/in", f"{base}/out", f"{base}/ck", EVENTS_CLEAN, max_files_per_trigger=1,
                         bucket_seconds=86400, fan_in=2).awaitTermination()
    got = spark.read.schema(CLEANED).parquet(f"{base}/out").select(*[f.name for f in CLEANED.fields]).collect()
    assert sorted(got) == sorted(C.clean_events(raw, EVENTS_CLEAN).collect())
    runs = seen_runs(spark, f"{base}/ck/seen")
    assert [r[0] for r in runs[1:]] == [r[1] + 1 for r in runs[:-1]] and runs[0][0] == 0 and runs[-1][1] == len(files) - 1
    assert len(runs) <= 2 * len(files).bit_length()
    keys = [f for f in RAW.fields if f.name in EVENTS_CLEAN.dedup_key]
    schema = T.StructType([*keys, T.StructField("_bucket", T.LongType())])
    known = lambda: sum(spark.read.schema(schema).parquet(p).count() for *_, p in seen_runs(spark, f"{base}/ck/seen"))
    before = known()
    assert before == raw.select(*EVENTS_CLEAN.dedup_key).distinct().count()
    last = 1 << (len(files).bit_length() - 1)
    merge_runs(spark, f"{base}/ck/seen", schema, last, 2)  # as a retried epoch would
    assert known() == before
