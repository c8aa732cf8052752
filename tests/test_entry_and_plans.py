"""Driver contract and plan shapes that the scale design depends on."""

from clickscope.operators import clean as C
from clickscope.operators import funnel as FN
from clickscope.plans.inputs import EVENTS_CLEAN, raw_events

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 53


def test_dedup_reduces_map_side_and_pushes_range(spark):
    df = C.clean_events(raw_events(spark, SF001), EVENTS_CLEAN)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # the epoch range predicate sits below the window, the behavior one above it
    assert opt.index("Window") < opt.rindex(">= 1704211200")


def test_conversion_has_no_expand(spark):
    df = FN.daily_conversion(C.clean_events(raw_events(spark, SF001), EVENTS_CLEAN))
    df.collect()
    assert "Expand" not in _plan(df)


def test_cleaned_scan_prunes_columns_and_partitions(spark):
    from clickscope.plans.inputs import cleaned_events
    from clickscope.session import shared_path
    from clickscope.sources.sinks import write_cleaned

    path = shared_path(spark, "test_cleaned")
    write_cleaned(cleaned_events(spark, SF001), path, partition_by_date=True)
    from pyspark.sql import functions as F

    df = spark.read.parquet(path).filter(F.col("date") == "2024-01-05").select("user_id", "behavior")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<user_id:int,behavior:string>" in plan
