"""Adapters from the given tables to the click-log shape the operators expect.

``events`` -> raw log ``(user_id, item_id, category_id, behavior, timestamp, ord)``:
types map view->pv, click->fav, signup->cart, purchase->buy (``error`` stays and plays
an invalid behavior); item = ``props.k``, category = ``k % 10``; every event whose id is a
multiple of ten gets a later copy with another behavior and category, so that keep-first
dedup has work to do.  ``ord`` is the input order.

``lineitem ⋈ orders ⋈ part`` -> buy events: user = customer, item = part,
category = brand, time = order date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscope.functions.timefn import epoch_seconds

# Fixed values of the adapter (event type -> behavior).
EVENT_TYPE_TO_BEHAVIOR = {"view": "pv", "click": "fav", "signup": "cart", "purchase": "buy"}
COPY_EVERY = 10  # every tenth event id gets a later duplicate row


def events_raw(events: DataFrame) -> DataFrame:
    """One scan of ``events``: every event yields its row, and every tenth event also a
    later copy (another behavior and category), through one ``explode``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    behavior = F.col("event_type")
    mapped = None
    for src, dst in EVENT_TYPE_TO_BEHAVIOR.items():
        mapped = (F.when(behavior == src, dst) if mapped is None else mapped.when(behavior == src, dst))
    base = events.select(
        F.col("event_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        k.alias("item_id"),
        (k % 10).alias("category_id"),
        mapped.otherwise(behavior).alias("behavior"),
        epoch_seconds("ts").alias("timestamp"),
    )
    first = F.struct(
        F.col("category_id").alias("category_id"), F.col("behavior").alias("behavior"),
        (F.col("event_id") * 2).alias("ord"),
    )
    copy = F.struct(
        (F.col("category_id") + 1).alias("category_id"), F.lit("buy").alias("behavior"),
        (F.col("event_id") * 2 + 1).alias("ord"),
    )
    rows = F.when(F.col("event_id") % COPY_EVERY == 0, F.array(first, copy)).otherwise(F.array(first))
    return base.select("user_id", "item_id", "timestamp", F.explode(rows).alias("r")).select(
        "user_id", "item_id", "r.category_id", "r.behavior", "timestamp", "r.ord"
    )


def funnel_events(cleaned: DataFrame) -> DataFrame:
    """Funnel input with a user-day as the funnel's user: ``user_id``, year and day of
    year in one number (over a whole month nearly every user passes every step)."""
    return cleaned.select(
        (F.col("user_id").cast("bigint") * 10_000_000 + F.year("datetime") * 1000 + F.dayofyear("datetime")).alias("user_id"),
        "behavior", "timestamp", "date", "hour",
    )


def orders_buy_events(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                      order_status: str | None = None) -> DataFrame:
    """Buy events ``(user_id, item_id, category_id, behavior, datetime)`` from order lines.

    Sort-merge (or AQE-broadcast) joins on the order and part keys; only the needed
    columns reach the scans.  ``order_status`` keeps the orders of one status."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    if order_status is not None:
        o = o.filter(F.col("o_orderstatus") == order_status)
    li = lineitem.select("l_orderkey", "l_partkey")
    p = part.select("p_partkey", "p_brand")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey, "left")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("p_brand").alias("category_id"),
            F.lit("buy").alias("behavior"),
            F.col("o_orderdate").alias("datetime"),
        )
    )
