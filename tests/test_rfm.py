"""RFM: elapsed days, scores on the five-user fixture, tercile sizes, ranks, histogram."""

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clickscope.functions.timefn import elapsed_days
from clickscope.operators import rfm as RF
from clickscope.operators.rank import bin_limits, order_statistics, qcut_bin, tercile_rule, unique_rank
from clickscope.params import RfmParams


def test_elapsed_days(spark):
    df = spark.createDataFrame(
        [(datetime(2017, 12, 3, 10),), (datetime(2017, 12, 3),), (datetime(2017, 12, 4, 1),)], "t timestamp_ntz"
    )
    got = [r.d for r in df.select(elapsed_days("t", datetime(2017, 12, 4)).alias("d")).collect()]
    assert got == [0, 1, 0]


def _five(spark):
    rows = [(1, 0, 1, 1), (2, 1, 1, 1), (3, 2, 1, 1), (4, 3, 2, 2), (5, 3, 5, 2)]
    return spark.createDataFrame(
        [(u, datetime(2017, 12, 1), f, m, r, m) for u, r, f, m in rows],
        "user_id int, last_buy_time timestamp_ntz, frequency long, category_count long, recency long, monetary long",
    )


def test_five_user_scores(spark):
    out = RF.score_rfm(_five(spark)).orderBy("user_id").collect()
    assert [(r.r_score, r.f_score, r.m_score) for r in out] == [(3, 1, 2), (3, 1, 2), (2, 2, 2), (1, 3, 2), (1, 3, 2)]
    assert [(r.r_level, r.f_level, r.m_level) for r in out] == [(2, 2, 2)] * 3 + [(1, 2, 2)] * 2
    assert [r.segment for r in out] == ["重要价值用户"] * 3 + ["一般价值用户"] * 2


def test_tercile_sizes_match_qcut(spark):
    for n in (9, 10, 11, 301):
        df = spark.range(1, n + 1).select(F.col("id").alias("rank"))
        got = sorted(r.b for r in df.select(qcut_bin("rank", n, 3).alias("b")).collect())
        want = sorted(pd.qcut(pd.Series(np.arange(1, n + 1), dtype=float), 3, labels=[1, 2, 3]).astype(int))
        assert got == want
        assert bin_limits(n, 3) == list(tercile_rule(n)) == [got.count(1), got.count(1) + got.count(2)]


def _scores_by_rank(rows):
    """r, f, m scores from pandas ranks and qcut, for rows of (user, recency, frequency, monetary)."""
    pdf = pd.DataFrame(rows, columns=["user_id", *RF.METRICS]).sort_values("user_id")
    out = {"user_id": pdf.user_id}
    for m in RF.METRICS:
        if pdf[m].nunique() >= 3:
            score = pd.qcut(pdf[m].rank(method="first"), 3, labels=[1, 2, 3]).astype(int)
            out[m] = 4 - score if m == "recency" else score
        else:
            half = pdf[m].median()
            out[m] = np.where(pdf[m] <= half if m == "recency" else pdf[m] >= half, 2, 1)
    return sorted(map(tuple, pd.DataFrame(out).to_numpy().tolist()))


def test_scores_from_value_counts_equal_ranking(spark):
    """Ties cut inside a value, values that end at a limit, n mod 3 = 0, 1, 2, wide ids and values."""
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 29, 30, 31):
        ids = r.choice(np.arange(-2**40, 2**40, 7919), n, replace=False)
        rows = [(int(u), int(r.integers(0, 4)), int(r.integers(-2**50, 2**50)), int(r.integers(1, 6)) // 3) for u in ids]
        df = spark.createDataFrame(rows, "user_id long, recency long, frequency long, monetary long")
        got = RF.score_rfm(df).select("user_id", "r_score", "f_score", "m_score").collect()
        assert sorted(map(tuple, got)) == _scores_by_rank(rows), n


def test_scoring_never_sorts_users(spark):
    rows = [(i, i % 7, i % 5 + 1, 1 if i % 3 else i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, recency long, frequency long, monetary long")
    plan = RF.score_rfm(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan


def test_order_statistics_of_signed_and_weighted_values(spark):
    values = [-2**62, -5, -5, 0, 3, 3, 3, 2**40, 2**62 - 1]
    df = spark.createDataFrame([(v, 1 + v % 3) for v in values], "v long, w long")
    alone, _ = order_statistics(df, {"a": (None, "v", range(1, 10))}, {"a": (-2**62, 2**62 - 1)})
    assert [alone["a", k].value for k in range(1, 10)] == values
    assert (alone["a", 6].below, alone["a", 6].equal) == (4, 3)
    spread = sorted(v for v in values for _ in range(1 + v % 3) if -10 < v < 9)
    some, distinct = order_statistics(df.where("v < 9"), {"b": (F.col("v") > -10, "v", [1, 4, len(spread)])}, {"b": (-5, 3)}, "w", cell_bits=3)
    assert distinct["b"] >= 2
    assert [some["b", k].value for k in (1, 4, len(spread))] == [spread[0], spread[3], spread[-1]]


def test_unique_rank_spreads_a_hot_tie_group(spark):
    # one value holds most rows: the range partitioning still splits it by user_id
    rows = [(i, 1 if i % 10 else i) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "user_id long, frequency long")
    ranked = unique_rank(df, ["frequency", "user_id"], "rk", num_partitions=8)
    got = {r.user_id: r.rk for r in ranked.collect()}
    want = {u: i + 1 for i, (u, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert got == want


def test_what_if_shift(spark):
    base = RF.score_rfm(_five(spark))
    assert sorted(RF.rfm_what_if(base, 0).collect()) == sorted(base.collect())
    shifted = RF.rfm_what_if(base, -2).orderBy("user_id").collect()
    assert [r.recency for r in shifted] == [0, 0, 0, 1, 1]


def test_histogram_matches_numpy(spark):
    vals = [1, 2, 3, 4, 7, 7, 9, 12]
    df = spark.createDataFrame([(i, v, v, 5) for i, v in enumerate(vals)],
                               "user_id int, recency long, frequency long, monetary long")
    h = RF.rfm_histogram(df).collect()
    for metric, col in (("recency", vals), ("monetary", [5] * len(vals))):
        bins = min(20, max(3, len(set(col))))
        counts, edges = np.histogram(col, bins=bins)
        got = [r.users for r in h if r.metric == metric]
        assert got == counts.tolist()
        assert [r.lower for r in h if r.metric == metric] == [round(e, 6) for e in edges[:-1].tolist()]


def test_empty_rfm(spark):
    empty = spark.createDataFrame([], "user_id int, item_id int, category_id int, behavior string, datetime timestamp_ntz")
    t = RF.rfm_table(empty, RfmParams())
    assert t.count() == 0 and "segment" in t.columns
    assert RF.rfm_summary_document(t) == {"total_buy_users": 0, "segment_counts": {}, "segment_ratio": {},
                                          "rfm_mean_by_segment": {}}


def test_summary_shares_sum_to_100(spark):
    from conftest import SF001

    from clickscope.plans.inputs import ORDERS_RFM, order_buys

    scored = RF.rfm_table(order_buys(spark, SF001), ORDERS_RFM)
    s = RF.rfm_summary(scored).collect()
    assert abs(sum(r.user_ratio for r in s) - 100) < 0.05
    assert sum(r.user_count for r in s) == scored.count() == s[0].total_buy_users
