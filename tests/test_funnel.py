"""Ordered funnel and conversion tables on the hand-derived fixture."""

from pyspark.sql import functions as F

from clickscope.operators import funnel as FN

EVENTS = [
    (1, "pv", 1), (1, "fav", 2), (1, "cart", 3), (1, "buy", 4),
    (2, "cart", 4), (2, "pv", 5), (2, "fav", 5),
    (3, "fav", 1), (3, "pv", 2),
    (4, "buy", 1),
    (5, "pv", 1), (5, "cart", 2), (5, "buy", 3),
]
SCHEMA = "user_id long, behavior string, timestamp long"


def _rows(df):
    return [(r.behavior, r.uv, r.independent_uv, r.actions, r.conversion_rate, r.loss_rate) for r in df.collect()]


def test_ordered_funnel_fixture(spark):
    f = FN.ordered_funnel(spark.createDataFrame(EVENTS, SCHEMA))
    assert _rows(f) == [
        ("pv", 4, 4, 4, 1.0, 0.0),
        ("fav", 2, 3, 3, 0.5, 0.5),
        ("cart", 1, 3, 3, 0.5, 0.5),
        ("buy", 1, 3, 3, 1.0, 0.0),
    ]
    assert [r.label for r in f.collect()] == ["浏览", "收藏", "加购", "购买"]
    assert [r.value for r in FN.funnel_flows(f).collect()] == [2, 1, 1]
    assert FN.funnel_overall(f).first().overall_buy_conversion_rate == 0.25


def test_zero_stage_rule(spark):
    f = FN.ordered_funnel(spark.createDataFrame([e for e in EVENTS if e[1] != "fav"], SCHEMA))
    rows = _rows(f)
    assert rows[1][1:2] == (0,) and rows[1][4:] == (0.0, 1.0)
    assert rows[2][1] == 0 and rows[2][4:] == (1.0, 0.0)
    assert rows[3][1] == 0 and rows[3][4:] == (1.0, 0.0)


def test_empty_input_gives_all_steps(spark):
    f = FN.ordered_funnel(spark.createDataFrame([], SCHEMA))
    assert _rows(f) == [(b, 0, 0, 0, 1.0, 0.0) for b in ("pv", "fav", "cart", "buy")]
    assert FN.funnel_overall(f).first().overall_buy_conversion_rate == 0.0


def test_day_without_pv_has_zero_conversion(spark):
    df = spark.createDataFrame(
        [(1, "buy", "2017-11-25"), (2, "pv", "2017-11-26"), (2, "buy", "2017-11-26"), (3, "pv", "2017-11-26")],
        "user_id long, behavior string, date string",
    )
    d = {r.date: (r.pv_uv, r.buy_uv, r.buy_conversion_rate) for r in FN.daily_conversion(df).collect()}
    assert d == {"2017-11-25": (0, 1, 0.0), "2017-11-26": (2, 1, 0.5)}


def test_funnel_properties_on_adapted_events(spark):
    from conftest import SF001

    from clickscope.plans.inputs import funnel_input

    f = FN.ordered_funnel(funnel_input(spark, SF001)).collect()
    uvs = [r.uv for r in f]
    assert uvs == sorted(uvs, reverse=True)
    assert all(r.uv <= r.independent_uv <= r.actions for r in f)


def test_summary_document_roundtrip(spark):
    from clickscope.schemas import FUNNEL_SUMMARY
    from clickscope.session import shared_path
    from clickscope.sources.sinks import read_summary_json, write_summary_json

    ev = spark.createDataFrame(EVENTS, SCHEMA).withColumn("date", F.lit("2017-11-25")).withColumn("hour", F.lit(1))
    f = FN.ordered_funnel(ev)
    doc = FN.funnel_summary(f, FN.daily_conversion(ev), FN.hourly_conversion(ev))
    path = shared_path(spark, "test_summary")
    write_summary_json(doc, path)
    back = read_summary_json(spark, path, FUNNEL_SUMMARY)
    assert sorted(FN.explode_funnel(back).collect()) == sorted(f.collect())
    row = back.first()
    assert (row.daily_rows, row.hourly_rows, row.overall_buy_conversion_rate) == (1, 1, 0.25)
    missing = read_summary_json(spark, path + "-absent", FUNNEL_SUMMARY)
    assert missing.count() == 0


def _brute_force_uv(pdf, steps=("pv", "fav", "cart", "buy")):
    uv = [0] * len(steps)
    for _, g in pdf.groupby("user_id"):
        t = None
        for i, b in enumerate(steps):
            ts = g.loc[g.behavior == b, "timestamp"]
            if t is not None:
                ts = ts[ts >= t]
            if ts.empty:
                break
            t = ts.min()
            uv[i] += 1
    return uv


def test_funnel_with_a_hot_user_matches_brute_force(spark):
    from conftest import SF01

    from clickscope.plans.inputs import funnel_input

    ev = funnel_input(spark, SF01)
    # a third of all events move onto one user
    hot = ev.withColumn("user_id", F.when(F.xxhash64("timestamp", "behavior") % 3 == 0, F.lit(-7))
                        .otherwise(F.col("user_id")))
    want = _brute_force_uv(hot.select("user_id", "behavior", "timestamp").toPandas())
    assert [r.uv for r in FN.ordered_funnel(hot).collect()] == want
    # with a low threshold the hot user is salted over many join partitions
    from clickscope.params import FunnelParams

    p = FunnelParams(hot_rows=50)
    facts = FN.user_behavior_facts(hot, p)
    h = FN.hot_users(facts, "fav", p)
    assert h is not None and h.filter(F.col("user_id") == -7).first()._splits > 5
    assert [r.uv for r in FN.ordered_funnel(hot, p).collect()] == want
    assert [step.count() for step in FN.stage_tables(hot, p)] == want


def test_select_dates_long_list_uses_semi_join(spark):
    df = spark.createDataFrame([(f"d{i}", i) for i in range(3000)], "date string, pv_uv long")
    few = FN.select_dates(df, ["d1", "d2"])
    many = FN.select_dates(df, [f"d{i}" for i in range(0, 3000, 2)])
    assert few.count() == 2 and many.count() == 1500
    assert FN.select_dates(df, None).count() == 3000


def test_salted_step_joins_on_user_and_salt(spark):
    from clickscope.params import FunnelParams

    rows = [(1, "pv", 0)] + [(1, "fav", t) for t in range(300)] + [(2, "pv", 5), (2, "fav", 6)]
    ev = spark.createDataFrame(rows, SCHEMA)
    p = FunnelParams(hot_rows=50)
    facts = FN.user_behavior_facts(ev, p)
    hot = FN.hot_users(facts, "fav", p)
    assert {r.user_id: r._splits for r in hot.collect()} == {1: 6}
    prev = facts.filter(F.col("behavior") == "pv").select("user_id", F.col("first_time").alias("previous_time"))
    step = FN.funnel_step(ev, prev, "fav", p, hot=hot)
    assert sorted(tuple(r) for r in step.collect()) == [(1, 0), (2, 6)]
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "explode" in plan


def test_states_compose_over_partitions_and_batches(spark):
    """One user holds most events; partitions and batches of a few rows cut it everywhere."""
    import random

    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice(["pv", "fav", "cart", "buy", "x"]), r.choice([None, *range(40)])) for _ in range(600)]
    rows += [(i, b, t) for i in range(10, 60) for b, t in zip(["pv", "fav", "cart", "buy"], [r.randint(0, 5) for _ in range(4)])]
    want = {}
    for user in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == user]
        at, reached = None, 0
        for b in ("pv", "fav", "cart", "buy"):
            times = [t for _, c, t in own if c == b and t is not None and (at is None or t >= at)]
            if not times:
                break
            at, reached = min(times), reached + 1
        want[user] = (reached, [sum(c == b for _, c, _ in own) for b in ("pv", "fav", "cart", "buy")])
    events = spark.createDataFrame(rows, SCHEMA)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set(key, size)
            got = {x.user: (x.reached, x.counts) for x in FN.funnel_states(events).collect()}
            assert got == want
            total = [(x.uv, x.independent_uv, x.actions) for x in FN.ordered_funnel(events).collect()]
            known = [v for k, v in want.items() if k is not None]
            assert total == [(sum(v[0] > i if i else v[1][0] > 0 for v in known), sum(v[1][i] > 0 for v in known),
                              sum(v[1][i] for v in want.values())) for i in range(4)]
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
