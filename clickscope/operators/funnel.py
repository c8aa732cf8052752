"""Ordered funnel and conversion tables.

A user's funnel is a running state over the events in time order: the number of steps
reached.  Events of one second may serve in any order, so what a run of events does to the
state is a small function, ``reached before -> reached after``, and the functions of runs
that follow one another compose.  ``ordered_funnel`` needs one pass:

* one range layout by (user, time): a very active user's events are cut by time into as
  many partitions as they need, and events of one second stay together;
* each task walks its sorted events in Arrow batches with numpy and emits one row per user
  (its *piece*: the function and the counts); a batch holds back its last second (as a
  number per step, however many events it has) and its last user's piece, so pieces never
  depend on where batches end;
* users that lie in one partition are counted in its task; the first and the last of each
  partition, at most one piece a partition, meet by user and compose in partition order.

The log is read once for the layout's sample (three columns) and once for the pass, and is
shuffled once.

``stage_tables`` gives the *times* of the steps per user: a chain of per-user thresholds.
Step 1 is the user's first time of the first behavior (``groupBy().min()``, map-side
combined); step i is the earliest event of behavior i not before the user's step i-1 time.
Nothing ever holds all events of one user in one task:

* the threshold table comes out of an aggregate, so AQE knows its exact size and turns
  the join into a broadcast join when it is small, a sort-merge join otherwise;
* in the sort-merge form a very active user would be one skewed join partition, and
  AQE's skew split does not apply when one join input comes out of an aggregate.  So the
  chain salts explicitly: the ``(user, behavior)`` pre-aggregate already counts each
  user's events, users above ``hot_rows`` get ``ceil(n / hot_rows)`` salts, their events
  are spread over the salts and their single threshold row is repeated per salt.  The
  hot-user table is broadcast; it is bounded by ``max_hot_users``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscope.functions.numeric import guarded_ratio, half_even
from clickscope.operators.clean import merge_one_row
from clickscope.params import FunnelParams
from clickscope.session import materialize, tune_for_skew

_P = FunnelParams()


def first_touch(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """First time per user and behavior: ``(user_id, behavior, first_time)``."""
    u, t = params.user_col, params.time_col
    return (
        events.filter(F.col("behavior").isin(list(params.steps)) & F.col(u).isNotNull())
        .groupBy(u, "behavior")
        .agg(F.min(t).alias("first_time"))
    )


def funnel_step(events: DataFrame, previous: DataFrame, behavior: str, params: FunnelParams = _P,
                out_col: str = "step_time", hot: DataFrame | None = None) -> DataFrame:
    """One funnel step: per user, the earliest ``behavior`` event at or after the user's
    previous-step time (``previous``: ``(user, previous_time)``).

    ``hot``: ``(user, _splits)`` for users with very many events of this behavior (a
    table bounded by ``FunnelParams.max_hot_users``, broadcast).  Their events are spread
    over ``_splits`` salts and their one threshold row is repeated once per salt, so
    no join task receives all events of a user; the partial ``min`` then shrinks each
    salt to one row before the final aggregate."""
    u, t = params.user_col, params.time_col
    cur = events.filter(F.col("behavior") == behavior).select(u, t)
    if hot is None:
        joined = cur.join(previous, u)
    else:
        h = F.broadcast(hot)
        splits = F.coalesce(F.col("_splits"), F.lit(1))
        cur = cur.join(h, u, "left").select(
            u, t, F.pmod(F.xxhash64(F.col(t), F.monotonically_increasing_id()), splits).cast("int").alias("_salt")
        )
        prev = previous.join(h, u, "left").select(
            u, "previous_time", F.explode(F.sequence(F.lit(0), splits - 1)).alias("_salt")
        )
        joined = cur.join(prev, [u, "_salt"])
    return (
        joined.filter(F.col(t) >= F.col("previous_time"))
        .groupBy(u)
        .agg(F.min(t).alias(out_col))
    )


def hot_users(facts: DataFrame, behavior: str, params: FunnelParams = _P,
              stats: dict | None = None) -> DataFrame | None:
    """Users with more than the hot threshold of ``behavior`` events and their split
    counts, from the ``(user, behavior)`` pre-aggregate; None when there are none.  At
    most ``max_hot_users`` rows: the threshold is at least total / max_hot_users.
    ``stats``: ``behavior -> (total events, largest per-user count)``."""
    u = params.user_col
    stats = stats if stats is not None else behavior_stats(facts, params)
    total, largest = stats.get(behavior, (0, 0))
    limit = max(params.hot_rows, -(-int(total) // params.max_hot_users))
    if largest <= limit:
        return None
    return facts.filter((F.col("behavior") == behavior) & F.col(u).isNotNull() & (F.col("n") > limit)).select(
        u, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("_splits")
    )


def behavior_stats(facts: DataFrame, params: FunnelParams = _P) -> dict:
    """``behavior -> (events, largest per-user count)``: one aggregate, one row per step."""
    rows = facts.filter(F.col(params.user_col).isNotNull()).groupBy("behavior").agg(
        F.sum("n").alias("total"), F.max("n").alias("largest")
    ).collect()
    return {r.behavior: (int(r.total), int(r.largest)) for r in rows}


def user_behavior_facts(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """One row per (user, behavior) of the funnel steps: first time and action count.
    A hash aggregate with map-side combine, so a very active user is pre-reduced in
    every map task.  It yields step 1 and the order-free facts of every step."""
    u, t = params.user_col, params.time_col
    return (
        events.filter(F.col("behavior").isin(list(params.steps)))
        .groupBy(u, "behavior")
        .agg(F.min(t).alias("first_time"), F.count(F.lit(1)).alias("n"))
    )


def stage_tables(events: DataFrame, params: FunnelParams = _P,
                 facts: DataFrame | None = None) -> list[DataFrame]:
    """One ``(user, step_time)`` table per funnel step, in step order.  Each table (one
    row per user that reached the step) is stored in the shared folder, so every
    step runs exactly once and later steps and counts read it back."""
    tune_for_skew(events.sparkSession)
    u = params.user_col
    ub = facts if facts is not None else user_behavior_facts(events, params)
    first = ub.filter((F.col("behavior") == params.steps[0]) & F.col(u).isNotNull()).select(
        u, F.col("first_time").alias("step_time")
    )
    stages = [first if facts is not None else materialize(first)]  # a filter of a stored table
    stats = behavior_stats(ub, params)
    for behavior in params.steps[1:]:
        prev = stages[-1].withColumnRenamed("step_time", "previous_time")
        hot = hot_users(ub, behavior, params, stats)
        stages.append(materialize(funnel_step(events, prev, behavior, params, hot=hot)))
    return stages


def _piece_walker(steps: int):
    """The task side of ``funnel_pieces``: sorted ``(part, user, time, step)`` batches to a row per
    user.  All that it calls is defined inside, so executors need no copy of this package."""
    import numpy as np

    def pieces(user, second, timed, step, weight):
        """``starts, after, counts`` of the runs of equal ``user`` numbers: ``after[s]`` is what
        is reached by the end of the run if ``s`` steps were before it."""
        n = len(user)
        starts = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        ends = np.r_[starts[1:], n]
        # first event of the same user and second
        same = np.r_[False, (user[1:] == user[:-1]) & (second[1:] == second[:-1])]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        coming = []  # coming[i][p]: the next event of step i + 1 from place p on, n if none
        for i in range(steps):
            at = np.where(timed & (step == i + 1), np.arange(n), n)
            coming.append(np.minimum.accumulate(at[::-1])[::-1])
        after_of = []
        for before in range(steps + 1):
            at, reached, live = starts.copy(), np.full(len(starts), before), np.ones(len(starts), bool)
            for i in range(before, steps):
                found = coming[i][at]
                live &= found < ends
                reached[live] = i + 1
                at = np.where(live, first[np.minimum(found, n - 1)], at)
            after_of.append(reached)
        counts = np.zeros((len(starts), steps), np.int64)
        np.add.at(counts, (run, step - 1), weight)
        return starts, np.stack(after_of, axis=1), counts

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "edge", "user", "after", "counts"]
        part, emitted = None, 0
        open_user, after, counts = None, None, None  # the piece that may go on
        kept = None  # the last second seen, a row a step

        def flat(x):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).astype(np.int64)))

        def rows(users, functions, numbers, last=False):
            nonlocal emitted
            edge = np.zeros(len(users), bool)
            edge[0] = last or not emitted
            emitted += len(users)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(users), part, np.int32)), pa.array(edge), users, flat(functions), flat(numbers)], names)

        def digest(table, last):
            nonlocal open_user, after, counts, kept
            user = table["user"].combine_chunks()
            number = user.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            time = table["time"].combine_chunks()
            second = time.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            timed = time.is_valid().to_numpy(zero_copy_only=False)
            step, weight = table["step"].to_numpy(), table["weight"].to_numpy()
            kept = None
            if not last:  # hold back the last second: more of it may come
                other = np.flatnonzero((number != number[-1]) | (second != second[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                found, at = np.unique(step[cut:], return_index=True)
                kept = table.slice(cut).take(pa.array(at)).set_column(
                    3, "weight", pa.array(np.bincount(step[cut:], weights=weight[cut:]).astype(np.int64)[found]))
                number, second, timed, step, weight, user = number[:cut], second[:cut], timed[:cut], step[:cut], weight[:cut], user.slice(0, cut)
                if not cut:
                    return
            starts, functions, numbers = pieces(number, second, timed, step, weight)
            users = user.take(pa.array(starts))
            if open_user is not None:
                if open_user[0].equals(users[0]):
                    functions[0], numbers[0] = functions[0][after], numbers[0] + counts
                else:
                    yield rows(open_user, after[None, :], counts[None, :])
            open_user, after, counts = users.slice(len(users) - 1), functions[-1].copy(), numbers[-1].copy()
            if len(users) > 1:
                yield rows(users.slice(0, len(users) - 1), functions[:-1], numbers[:-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            table = pa.Table.from_arrays([*batch.columns[1:], pa.array(np.ones(batch.num_rows, np.int64))], ["user", "time", "step", "weight"])
            yield from digest(table if kept is None else pa.concat_tables([kept, table]), False)
        if kept is not None:
            yield from digest(kept, True)
            yield rows(open_user, after[None, :], counts[None, :], True)

    return walk


def funnel_pieces(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """``part, edge, user, after, counts``: for every partition of the range layout by (user,
    time) and every user in it, the steps reached after the partition's events for each number
    of steps reached before (``after[0..n]``), and the events of each step.  ``edge`` marks the
    first and the last user of a partition; all others lie in it whole.

    Null users are one user here; events without a time count and reach nothing."""
    u, t = params.user_col, params.time_col
    step = F.lit(None).cast("int")
    for i, b in enumerate(params.steps, 1):
        step = F.when(F.col("behavior") == b, F.lit(i)).otherwise(step)
    own = events.where(F.col("behavior").isin(list(params.steps))).select(F.col(u).alias("user"), F.col(t).alias("time"), step.alias("step"))
    laid = own.repartitionByRange("user", "time").sortWithinPartitions("user", "time")
    laid = laid.select(F.spark_partition_id().alias("part"), "user", "time", "step")
    kind = own.schema["user"].dataType.simpleString()
    return laid.mapInArrow(_piece_walker(len(params.steps)), f"part int, edge boolean, user {kind}, after array<long>, counts array<long>")


def _composed(pieces: Column) -> Column:
    """Steps reached after ``(part, after)`` pieces, in partition order, from none."""
    return F.aggregate(F.array_sort(pieces), F.lit(0).cast("long"), lambda state, piece: F.element_at(piece["after"], (state + 1).cast("int")))


def funnel_states(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """``user, reached, counts`` of every user: steps reached in order, and the number of
    events of each step."""
    counts = F.array(*[F.sum(F.col("counts")[i]) for i in range(len(params.steps))])
    runs = F.collect_list(F.struct("part", "after"))  # at most one a partition
    return funnel_pieces(events, params).groupBy("user").agg(_composed(runs).alias("reached"), counts.alias("counts"))


def _funnel_totals(events: DataFrame, params: FunnelParams) -> DataFrame:
    """``step, behavior, label, uv, independent_uv, actions``, a row a step.  Users that lie in one partition are counted in
    its task; only those on the edges meet by user."""
    n, known, edge = range(len(params.steps)), F.col("user").isNotNull(), F.col("edge")
    # whoever has the first step at all has reached it
    came = lambda i, reached, first: known & ((reached > i) if i else (first > 0))
    own = funnel_pieces(events, params).groupBy("edge", F.when(edge, F.col("user")).alias("user_")).agg(
        F.collect_list(F.when(edge, F.struct("part", "after"))).alias("runs"),
        *[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in n],
        *[F.count_if(~edge & came(i, F.col("after")[0], F.col("counts")[0])).alias(f"u{i}") for i in n],
        *[F.count_if(~edge & known & (F.col("counts")[i] > 0)).alias(f"d{i}") for i in n])
    own = own.withColumnRenamed("user_", "user").withColumn("reached", _composed(F.col("runs")))
    one = lambda c: F.when(c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    totals = own.agg(*[x for i in n for x in (
        F.sum(F.when(edge, one(came(i, F.col("reached"), F.col("n0")))).otherwise(F.col(f"u{i}"))).alias(f"uv{i}"),
        F.sum(F.when(edge, one(known & (F.col(f"n{i}") > 0))).otherwise(F.col(f"d{i}"))).alias(f"independent{i}"),
        F.sum(f"n{i}").alias(f"actions{i}"))])
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(b).alias("behavior"), F.lit(params.labels.get(b, b)).alias("label"), *[
            F.coalesce(F.col(f"{c}{i}"), F.lit(0)).cast("long").alias(name)
            for c, name in (("uv", "uv"), ("independent", "independent_uv"), ("actions", "actions"))])
        for i, b in enumerate(params.steps)])).alias("x")).select("x.*")


def ordered_funnel(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """The funnel table, one row per step (always all steps, also for empty input):
    ``step, behavior, label, uv, independent_uv, actions, conversion_rate, loss_rate``.

    ``uv`` counts users that reached the step in order (non-strict ``>=``);
    ``independent_uv`` / ``actions`` ignore order.  Conversion is to the previous step;
    step 1, or a previous UV of 0, gives conversion 1.0 and loss 0.0.  Loss is 1 minus
    the unrounded conversion; both are rounded half-even to 4 places."""
    base = _funnel_totals(events, params)  # a row a step: a whole-table window is bounded
    prev = F.lag("uv").over(Window.orderBy("step"))
    ratio = F.col("uv").cast("double") / F.col("_prev").cast("double")
    has_prev = F.col("_prev").isNotNull() & (F.col("_prev") != 0)
    return (
        base.withColumn("_prev", prev)
        .withColumn("conversion_rate", half_even(F.when(has_prev, ratio).otherwise(F.lit(1.0)), 4))
        .withColumn("loss_rate", half_even(F.when(has_prev, 1.0 - ratio).otherwise(F.lit(0.0)), 4))
        .drop("_prev")
        .orderBy("step")
    )


def funnel_flows(funnel: DataFrame) -> DataFrame:
    """Links between consecutive steps: ``value = min(uv_i, uv_{i+1})``."""
    w = Window.orderBy("step")
    return (
        funnel.select(
            "step",
            F.col("label").alias("source"),
            F.lead("label").over(w).alias("target"),
            F.least(F.col("uv"), F.lead("uv").over(w)).alias("value"),
        )
        .filter(F.col("target").isNotNull())
        .orderBy("step")
    )


def funnel_overall(funnel: DataFrame, params: FunnelParams = _P) -> DataFrame:
    """Overall conversion last step UV / first step UV (0.0 when the first is 0), unrounded."""
    first, last = params.steps[0], params.steps[-1]
    pv = F.max(F.when(F.col("behavior") == first, F.col("uv")))
    buy = F.max(F.when(F.col("behavior") == last, F.col("uv")))
    return funnel.agg(
        pv.alias("first_uv"),
        buy.alias("last_uv"),
        F.coalesce(F.try_divide(buy.cast("double"), pv.cast("double")), F.lit(0.0)).alias(
            "overall_buy_conversion_rate"
        ),
    )


def conversion_by(events: DataFrame, key: str, params: FunnelParams = _P) -> DataFrame:
    """Distinct users per ``key`` value and behavior, one column per step, 0 filled,
    plus ``buy_conversion_rate = last_uv / first_uv`` (0.0 when no first-step user).

    Distinct ``(key, behavior, user)`` first (map-side combined), then one conditional
    count per step: two exchanges, no ``Expand``.  Keys whose events are all of other
    behaviors still get a row of zeros."""
    u = params.user_col
    d = (
        events.filter(F.col(key).isNotNull() & F.col("behavior").isNotNull())
        .select(key, "behavior", u)
        .distinct()
    )
    cols = [
        F.count_if((F.col("behavior") == b) & F.col(u).isNotNull()).cast("long").alias(f"{b}_uv")
        for b in params.steps
    ]
    first, last = params.steps[0], params.steps[-1]
    return (
        d.groupBy(key)
        .agg(*cols)
        .withColumn("buy_conversion_rate", guarded_ratio(f"{last}_uv", f"{first}_uv", 4))
        .orderBy(key)
    )


def daily_conversion(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    return conversion_by(events, "date", params)


def hourly_conversion(events: DataFrame, params: FunnelParams = _P) -> DataFrame:
    return conversion_by(events, "hour", params)


def select_dates(daily: DataFrame, dates: list[str] | tuple[str, ...] | None) -> DataFrame:
    """Rows of the chosen dates; no selection means all rows.  A semi-join with the
    selection, whose strategy Spark picks by its size."""
    if not dates:
        return daily
    chosen = daily.sparkSession.createDataFrame([(d,) for d in dates], "date string")
    return daily.join(chosen, "date", "left_semi")


def funnel_summary(funnel: DataFrame, daily: DataFrame, hourly: DataFrame,
                   params: FunnelParams = _P) -> DataFrame:
    """The funnel summary document as one row: ``funnel`` (array of step records, in
    step order), ``daily_rows``, ``hourly_rows``, ``overall_buy_conversion_rate``.
    Each part is a one-row aggregate; they are merged by union (no join)."""
    recs = funnel.agg(
        F.array_sort(
            F.collect_list(F.struct(
                "step", "behavior", "label", "uv", "independent_uv", "actions",
                "conversion_rate", "loss_rate",
            ))
        ).alias("funnel")
    )
    d = daily.agg(F.count(F.lit(1)).cast("long").alias("daily_rows"))
    h = hourly.agg(F.count(F.lit(1)).cast("long").alias("hourly_rows"))
    o = funnel_overall(funnel, params).select("overall_buy_conversion_rate")
    return merge_one_row(recs, d, h, o)


def funnel_summary_flat(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.size("funnel").cast("long").alias("funnel_steps"),
        "daily_rows", "hourly_rows", "overall_buy_conversion_rate",
    )


def explode_funnel(summary: DataFrame) -> DataFrame:
    """Step records of a (read-back) funnel summary document, one row each."""
    return summary.select(F.explode("funnel").alias("r")).select("r.*").orderBy("step")


__all__ = [
    "first_touch", "funnel_step", "stage_tables", "user_behavior_facts", "funnel_pieces", "funnel_states", "ordered_funnel", "funnel_flows", "funnel_overall",
    "conversion_by", "daily_conversion", "hourly_conversion", "select_dates", "funnel_summary",
    "funnel_summary_flat", "explode_funnel",
]


