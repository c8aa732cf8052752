"""Bitmap partials: exact counts, whichever way the parts were cut."""

import random

from pyspark.sql import functions as F

from clickscope.operators import clean as C
from clickscope.operators.distinct import distinct_counts, distinct_partials, merge_partials
from clickscope.schemas import CLEANING_SUMMARY

IDS = "date string, a int, b long"


def _rows():
    r = random.Random(9)
    edges = [0, -1, 1, 32767, 32768, 32769, -32767, -32768, -32769, 2**31 - 1, -(2**31), None]
    return [(f"d{r.randint(0, 4)}", r.choice(edges + list(range(50))), r.choice([None, 2**40, -(2**40), *range(9)])) for _ in range(500)]


def test_counts_by_day_and_merged(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, IDS).repartition(7)
    parts = distinct_partials(df, ["a", "b"], ("date",))
    by_day = {r["date"]: (r["a"], r["b"]) for r in distinct_counts(parts, ["a", "b"], ("date",)).collect()}
    assert by_day == {d: (len({x[1] for x in rows if x[0] == d}), len({x[2] for x in rows if x[0] == d})) for d in {x[0] for x in rows}}
    whole = distinct_counts(merge_partials(parts), ["a", "b"]).first()
    assert (whole["a"], whole["b"]) == (len({x[1] for x in rows}), len({x[2] for x in rows}))
    # loads that overlap, merged twice over
    low, high = df.where("date < 'd3'"), df.where("date > 'd0'")
    both = distinct_partials(low, ["a", "b"]).unionByName(distinct_partials(high, ["a", "b"]))
    assert tuple(distinct_counts(merge_partials(merge_partials(both)), ["a", "b"]).first()) == tuple(whole)
    none = distinct_partials(df.where("false"), ["a", "b"])
    assert tuple(distinct_counts(merge_partials(none), ["a", "b"]).first()) == (0, 0)


def test_no_row_is_expanded(spark):
    df = spark.createDataFrame([(1, 2, 3)], "user_id int, item_id int, category_id int").withColumn(
        "datetime", F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = C.cleaning_overview(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan
    assert tuple(C.cleaning_overview(df.where("false")).first()) == (0, 0, 0, 0, None, None)


def test_overview_without_a_summary(spark):
    """No document yet: one row without figures' dates."""
    none = C.overview_of_summary(spark.createDataFrame([], CLEANING_SUMMARY)).collect()
    assert [tuple(r) for r in none] == [(None, None, None, None, None)]
