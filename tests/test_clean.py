"""Cleaning: hand-derived micro-fixture, order key over file splits, malformed CSV,
audits, properties."""

import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickscope.operators import clean as C
from clickscope.params import CleanParams
from clickscope.sources import raw as R

from conftest import SF001

# r0..r6 of the micro-fixture (range 2017-11-25 .. 2017-12-03, UTC+8)
LINES = [
    "1,10,100,click,1511544000",
    "1,10,100,pv,1511544000",
    "1,11,100,pv,1511539200",
    "1,11,101,buy,1511539200",
    "2,12,100,buy,1512316799",
    "2,12,100,buy,1512316800",
    "2,12,100,pv,1511539199",
]


def _csv(lines, trailing_blank=False):
    d = tempfile.mkdtemp(prefix="clickscope-test-")
    path = f"{d}/raw.csv"
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n" + ("\n" if trailing_blank else ""))
    return path


def test_micro_fixture_clean(spark):
    raw = R.read_raw_ordered(spark, _csv(LINES))
    out = C.clean_events(raw, CleanParams()).orderBy("user_id").collect()
    assert [(r.user_id, r.item_id, r.category_id, r.behavior, r.hour, r.weekday) for r in out] == [
        (1, 11, 100, "pv", 0, 5),
        (2, 12, 100, "buy", 23, 6),
    ]
    assert out[0].datetime == datetime(2017, 11, 25, 0, 0, 0)
    assert out[1].date == "2017-12-03"


def test_micro_fixture_audit(spark):
    path = _csv(LINES)
    raw = R.read_raw_ordered(spark, path)
    cleaned = C.clean_events(raw)
    a = C.cleaning_audit(raw, cleaned, raw_rows=R.raw_row_count(spark, path)).first().asDict()
    assert a == dict(raw_rows=7, after_behavior_filter_rows=6, out_of_range_rows=2, after_date_filter_rows=4,
                     invalid_behavior_rows=1, final_rows=2, global_duplicate_rows=2, total_removed_rows=5)
    s = C.cleaning_stage_counts(raw).first().asDict()
    assert (s["after_dedup_rows"], s["after_behavior_filter_rows"], s["invalid_behavior_rows"],
            s["out_of_range_rows"], s["after_date_filter_rows"]) == (5, 4, 1, 2, 2)


def test_zone_mode_equals_fixed_offset_for_shanghai(spark):
    raw = R.read_raw_ordered(spark, _csv(LINES))
    a = C.clean_events(raw, CleanParams()).collect()
    b = C.clean_events(raw, CleanParams(tz_mode="zone")).collect()
    assert sorted(a) == sorted(b)


def test_after_filter_scope_keeps_valid_duplicate(spark):
    raw = R.read_raw_ordered(spark, _csv(LINES))
    out = C.clean_events(raw, CleanParams(dedup_scope="after_filter")).collect()
    # r1 (pv, 2017-11-25 01:20 local) is no longer shadowed by the invalid r0; r2 still wins over r3
    assert sorted((r.user_id, r.item_id, r.behavior) for r in out) == [(1, 10, "pv"), (1, 11, "pv"), (2, 12, "buy")]


def test_malformed_csv_fails_fast_even_when_pruned(spark):
    path = _csv(["1,2,3,pv,4", "q,2,3,pv,5", "1,2,3"])
    with pytest.raises(Exception):
        R.read_raw(spark, path).select("behavior").count()
    minus = C.coerce_ids(R.read_raw(spark, path, on_bad_id="minus_one").select("user_id", "behavior"), ("user_id",))
    assert sorted(r.user_id for r in minus.collect()) == [-1, 1, 1]


def test_raw_row_count_counts_blank_lines(spark):
    path = _csv(["1,2,3,pv,4", "2,2,3,pv,5"], trailing_blank=True)
    assert R.raw_row_count(spark, path).first().raw_rows == 3
    assert R.read_raw(spark, path).count() == 2


def test_order_key_follows_lines_across_splits(spark):
    from clickscope.plans.inputs import raw_events
    from clickscope.session import shared_path

    raw = raw_events(spark, SF001)
    path = shared_path(spark, "test_raw_csv")
    R.write_raw_csv(raw, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scanned = R.read_raw_ordered(spark, path)
        assert scanned.rdd.getNumPartitions() > 3
        got = C.dedup_keep_first(scanned).select(*[f.name for f in R.RAW.fields]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = C.dedup_keep_first(raw).select(*[f.name for f in R.RAW.fields]).collect()
    assert sorted(got) == sorted(want)


def test_clean_is_idempotent_and_partition_independent(spark):
    from clickscope.plans.inputs import EVENTS_CLEAN, raw_events

    raw = raw_events(spark, SF001)
    once = C.clean_events(raw, EVENTS_CLEAN)
    again = C.clean_events(
        once.select("user_id", "item_id", "category_id", "behavior", "timestamp",
                    F.col("timestamp").alias("ord")).select(
            *[F.col(c).cast("long") if c != "behavior" else F.col(c) for c in
              ("user_id", "item_id", "category_id", "behavior", "timestamp", "ord")]),
        EVENTS_CLEAN,
    )
    assert sorted(once.collect()) == sorted(again.collect())
    assert once.count() == 624  # FIXTURES: cleaned rows at sf0.001
    spread = C.clean_events(raw.repartition(13), EVENTS_CLEAN)
    assert sorted(spread.collect()) == sorted(once.collect())


def test_adapter_counts_match_fixture_table(spark):
    from clickscope.plans.inputs import EVENTS_CLEAN, raw_events

    raw = raw_events(spark, SF001)
    a = C.cleaning_audit(raw, C.clean_events(raw, EVENTS_CLEAN), EVENTS_CLEAN).first()
    assert (a.raw_rows, a.after_behavior_filter_rows, a.out_of_range_rows, a.final_rows) == (1100, 899, 196, 624)
    counts = {r.behavior: r.rows for r in C.behavior_counts(C.clean_events(raw, EVENTS_CLEAN)).collect()}
    assert counts == {"pv": 146, "fav": 162, "cart": 156, "buy": 160}


def test_overview_counts_null_as_a_value(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "pv", datetime(2017, 11, 25)), (None, 1, 2, "pv", datetime(2017, 11, 26))],
        "user_id int, item_id int, category_id int, behavior string, datetime timestamp_ntz",
    )
    o = C.cleaning_overview(df).first()
    assert (o.user_count, o.item_count, o.category_count) == (2, 1, 2)
    assert (o.start, o.end) == ("2017-11-25 00:00:00", "2017-11-26 00:00:00")


def test_order_key_spans_several_files_in_path_order(spark):
    d = tempfile.mkdtemp(prefix="clickscope-files-")
    # the same key appears in three files; the first file by path order must win
    for name, beh in (("b.csv", "fav"), ("a.csv", "click"), ("c.csv", "buy")):
        with open(f"{d}/{name}", "w") as fh:
            fh.write(f"1,10,100,{beh},1511544000\n2,11,100,{beh},1511544001\n")
    raw = R.read_raw_ordered(spark, d)
    first = {r.user_id: r.behavior for r in C.dedup_keep_first(raw).collect()}
    assert first == {1: "click", 2: "click"}
    assert isinstance(raw.select("ord.file").first()[0], int)
