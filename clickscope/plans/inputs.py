"""Inputs of the registered queries: the given tables through the adapters.

Every query reads whole tables; nothing is sampled or capped here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickscope.operators.clean import clean_events
from clickscope.params import CleanParams, RfmParams
from clickscope.session import materialize
from clickscope.sources.adapters import events_raw, funnel_events, orders_buy_events

# The adapted event log spans January 2024 (local time UTC+8).
EVENTS_CLEAN = CleanParams(start_date="2024-01-03", end_date="2024-01-25")
# Order dates run to 2001-08-01; the reference instant is the day after.
ORDERS_RFM = RfmParams(analysis_end="2001-08-02")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_raw(table(spark, sf_dir, "events"))


def cleaned_events(spark: SparkSession, sf_dir: str, params: CleanParams = EVENTS_CLEAN) -> DataFrame:
    return clean_events(raw_events(spark, sf_dir), params)


def funnel_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel reads its input in several passes; like the cleaned table the clean
    job writes, it is materialized once in the shared folder."""
    return materialize(funnel_events(cleaned_events(spark, sf_dir)))


def order_buys(spark: SparkSession, sf_dir: str, order_status: str | None = None) -> DataFrame:
    return orders_buy_events(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"),
        order_status,
    )
