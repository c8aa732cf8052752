"""Property tests: operators against plain Python over tuples, written from the rules, on
random small inputs."""

from collections import defaultdict

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clickscope.operators import clean as C
from clickscope.operators import funnel as FN
from clickscope.operators import rfm as RF

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
STEPS = ["pv", "fav", "cart", "buy"]
BEHAVIORS = [*STEPS, "click"]
EVENT = "user_id int, item_id int, behavior string, timestamp int"

events = st.lists(
    st.tuples(st.integers(1, 4), st.integers(1, 3), st.sampled_from(BEHAVIORS), st.integers(0, 6)),
    min_size=1, max_size=40,
)


@SETTINGS
@given(events)
def test_keep_first(spark, rows):
    first = {}
    for place, (user, item, _, at) in enumerate(rows):
        first.setdefault((user, item, at), place)
    df = spark.createDataFrame([(*r, 1, place) for place, r in enumerate(rows)], f"{EVENT}, category_id int, ord int")
    assert sorted(r.ord for r in C.dedup_keep_first(df).select("ord").collect()) == sorted(first.values())


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(events)
def test_ordered_funnel(spark, rows):
    log = defaultdict(list)
    for user, _, behavior, at in rows:
        log[user].append((at, behavior))
    reached = [0] * len(STEPS)
    for own in log.values():  # one user: the earliest time each step can be reached
        since = 0
        for k, step in enumerate(STEPS):
            later = [at for at, behavior in own if behavior == step and at >= since]
            if not later:
                break
            since = min(later)
            reached[k] += 1
    got = FN.ordered_funnel(spark.createDataFrame(rows, EVENT)).collect()
    assert [r.uv for r in got] == reached
    for r, step in zip(got, STEPS):
        own = [user for user, _, behavior, _ in rows if behavior == step]
        assert (r.independent_uv, r.actions) == (len(set(own)), len(own))


@SETTINGS
@given(events)
def test_daily_conversion(spark, rows):
    users = defaultdict(set)
    dated = [(*r, f"2017-11-2{r[3] % 3}") for r in rows]
    for user, _, behavior, _, day in dated:
        users[day, behavior].add(user)
    want = {}
    for day in {r[4] for r in dated}:
        n = [len(users[day, step]) for step in STEPS]
        want[day] = (*n, round(n[3] / n[0], 4) if n[0] else 0.0)
    got = FN.daily_conversion(spark.createDataFrame(dated, f"{EVENT}, date string")).collect()
    assert {r.date: (r.pv_uv, r.fav_uv, r.cart_uv, r.buy_uv, r.buy_conversion_rate) for r in got} == want


def _levels(values, higher):
    """2 on the good side of the median or at it; twice the median is a whole number."""
    line = sorted(values)
    twice = line[(len(line) - 1) // 2] + line[len(line) // 2]
    return [2 if (2 * v >= twice if higher else 2 * v <= twice) else 1 for v in values]


def _scores(values, higher):
    """By place in (value, user) order: the first (n + 1) // 3 places, the next n // 3, the
    rest; fewer than three distinct values are split at the median."""
    if len(set(values)) < 3:
        return _levels(values, higher)
    n, out = len(values), [0] * len(values)
    for place, k in enumerate(sorted(range(n), key=lambda k: (values[k], k))):
        third = 1 if place < (n + 1) // 3 else 2 if place < (n + 1) // 3 + n // 3 else 3
        out[k] = third if higher else 4 - third
    return out


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 6), st.integers(1, 4)), min_size=3, max_size=60))
def test_scores(spark, rows):
    df = spark.createDataFrame([(k + 1, *r, r[2]) for k, r in enumerate(rows)],
                               "user_id int, recency long, frequency long, monetary long, category_count long")
    df = df.selectExpr("*", "timestamp_ntz'2017-12-01 00:00:00' AS last_buy_time")
    got = RF.score_rfm(df).orderBy("user_id").collect()
    r, f, m = zip(*rows)
    assert [x.r_score for x in got] == _scores(r, False)
    assert [x.f_score for x in got] == _scores(f, True)
    assert [x.m_score for x in got] == _scores(m, True)
    assert [x.r_level for x in got] == _levels(r, False)


def test_an_event_without_a_user_scores_nobody(spark):
    rows = [(u, 1, str(k), "buy") for u in range(1, 10) for k in range(u)]
    schema = "user_id int, item_id int, category_id string, behavior string"
    made = [RF.rfm_table(spark.createDataFrame(x, schema).selectExpr("*", "timestamp_ntz'2017-12-01 00:00:00' AS datetime")).collect()
            for x in (rows, rows + [(None, 1, "x", "buy")] * 4)]
    assert sorted(map(str, made[0])) == sorted(map(str, made[1]))


@SETTINGS
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80))
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(i, v, v, v) for i, v in enumerate(values)],
                               "user_id int, recency long, frequency long, monetary long")
    h = [r.users for r in RF.rfm_histogram(df).collect() if r.metric == "recency"]
    counts, _ = np.histogram(values, bins=min(20, max(3, len(set(values)))))
    assert h == counts.tolist()
