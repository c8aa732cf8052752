"""DuckDB oracle SQL for the registered queries (views of the given tables are
pre-registered under their names).  Column names equal the Spark results'."""

from __future__ import annotations

# The adapter and the cleaning rules written independently in DuckDB SQL.
RAW_CTE = """
raw0 AS (
  SELECT event_id, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS category_id,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'fav'
              WHEN 'signup' THEN 'cart' WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior,
         epoch_us(ts) // 1000000 AS timestamp
  FROM events),
raw AS (
  SELECT user_id, item_id, category_id, behavior, timestamp, event_id * 2 AS ord FROM raw0
  UNION ALL
  SELECT user_id, item_id, category_id + 1, 'buy', timestamp, event_id * 2 + 1 FROM raw0 WHERE event_id % 10 = 0)
"""

CLEAN_CTE = RAW_CTE + """,
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM raw),
v AS (SELECT *, make_timestamp((timestamp + 28800) * 1000000) AS datetime
      FROM d WHERE rn = 1 AND behavior IN ('pv', 'fav', 'cart', 'buy')),
cleaned AS (
  SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id,
         CAST(category_id AS INTEGER) AS category_id, behavior, timestamp, datetime,
         strftime(datetime, '%Y-%m-%d') AS date,
         CAST(hour(datetime) AS TINYINT) AS hour, CAST(isodow(datetime) - 1 AS TINYINT) AS weekday
  FROM v
  WHERE datetime >= TIMESTAMP '2024-01-03 00:00:00' AND datetime < TIMESTAMP '2024-01-26 00:00:00')
"""

FUNNEL_CTE = CLEAN_CTE + """,
fe AS (SELECT CAST(user_id AS BIGINT) * 10000000 + year(datetime) * 1000 + dayofyear(datetime) AS user_id, behavior, timestamp, date, hour
       FROM cleaned),
s1 AS (SELECT user_id, min(timestamp) AS t FROM fe WHERE behavior = 'pv' GROUP BY user_id),
s2 AS (SELECT e.user_id, min(e.timestamp) AS t FROM fe e JOIN s1 ON e.user_id = s1.user_id
       WHERE e.behavior = 'fav' AND e.timestamp >= s1.t GROUP BY e.user_id),
s3 AS (SELECT e.user_id, min(e.timestamp) AS t FROM fe e JOIN s2 ON e.user_id = s2.user_id
       WHERE e.behavior = 'cart' AND e.timestamp >= s2.t GROUP BY e.user_id),
s4 AS (SELECT e.user_id, min(e.timestamp) AS t FROM fe e JOIN s3 ON e.user_id = s3.user_id
       WHERE e.behavior = 'buy' AND e.timestamp >= s3.t GROUP BY e.user_id),
steps AS (SELECT * FROM (VALUES (1, 'pv', '浏览'), (2, 'fav', '收藏'), (3, 'cart', '加购'), (4, 'buy', '购买'))
          AS t(step, behavior, label)),
uvs AS (SELECT 1 AS step, count(*) AS uv FROM s1 UNION ALL SELECT 2, count(*) FROM s2
        UNION ALL SELECT 3, count(*) FROM s3 UNION ALL SELECT 4, count(*) FROM s4),
facts AS (SELECT behavior, count(DISTINCT user_id) AS independent_uv, count(*) AS actions FROM fe
          WHERE behavior IN ('pv', 'fav', 'cart', 'buy') GROUP BY behavior),
fb AS (SELECT s.step, s.behavior, s.label, CAST(coalesce(u.uv, 0) AS BIGINT) AS uv,
              CAST(coalesce(f.independent_uv, 0) AS BIGINT) AS independent_uv,
              CAST(coalesce(f.actions, 0) AS BIGINT) AS actions,
              lag(coalesce(u.uv, 0)) OVER (ORDER BY s.step) AS prev
       FROM steps s LEFT JOIN uvs u ON s.step = u.step LEFT JOIN facts f ON s.behavior = f.behavior),
funnel AS (SELECT CAST(step AS INTEGER) AS step, behavior, label, uv, independent_uv, actions,
                  round_even(CASE WHEN prev IS NOT NULL AND prev <> 0 THEN uv / prev ELSE 1.0 END, 4) AS conversion_rate,
                  round_even(CASE WHEN prev IS NOT NULL AND prev <> 0 THEN 1.0 - uv / prev ELSE 0.0 END, 4) AS loss_rate
           FROM fb)
"""
# the same per user, as the cleaned log has them
USER_FUNNEL_CTE = FUNNEL_CTE.replace(
    "CAST(user_id AS BIGINT) * 10000000 + year(datetime) * 1000 + dayofyear(datetime) AS user_id", "user_id")


def conversion_sql(key: str, source: str = "cleaned") -> str:
    return f"""
SELECT {key},
       CAST(count_if(behavior = 'pv' AND user_id IS NOT NULL) AS BIGINT) AS pv_uv,
       CAST(count_if(behavior = 'fav' AND user_id IS NOT NULL) AS BIGINT) AS fav_uv,
       CAST(count_if(behavior = 'cart' AND user_id IS NOT NULL) AS BIGINT) AS cart_uv,
       CAST(count_if(behavior = 'buy' AND user_id IS NOT NULL) AS BIGINT) AS buy_uv,
       coalesce(round_even(CAST(count_if(behavior = 'buy' AND user_id IS NOT NULL) AS DOUBLE)
                / nullif(count_if(behavior = 'pv' AND user_id IS NOT NULL), 0), 4), 0.0) AS buy_conversion_rate
FROM (SELECT DISTINCT {key}, behavior, user_id FROM {source} WHERE {key} IS NOT NULL AND behavior IS NOT NULL)
GROUP BY {key} ORDER BY {key}"""


CLEANED_SELECT = "SELECT user_id, item_id, category_id, behavior, timestamp, datetime, date, hour, weekday FROM cleaned"

SQL: dict[str, str] = {
    "scan_raw": f"WITH {RAW_CTE} SELECT user_id, item_id, category_id, behavior, timestamp FROM raw",
    "scan_raw_ordered": f"""WITH {RAW_CTE},
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM raw)
SELECT user_id, item_id, category_id, behavior, timestamp FROM d WHERE rn = 1""",
    "raw_row_count": f"WITH {RAW_CTE} SELECT count(*) AS raw_rows FROM raw",
    "local_time": f"""WITH {RAW_CTE}
SELECT user_id, item_id, timestamp, ord, make_timestamp((timestamp + 28800) * 1000000) AS datetime,
       timezone('Asia/Shanghai', to_timestamp(timestamp)) AS datetime_zone,
       strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d') AS date,
       CAST(hour(make_timestamp((timestamp + 28800) * 1000000)) AS TINYINT) AS hour,
       CAST(isodow(make_timestamp((timestamp + 28800) * 1000000)) - 1 AS TINYINT) AS weekday
FROM raw""",
    "dedup_keep_first": f"""WITH {RAW_CTE},
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM raw)
SELECT user_id, item_id, category_id, behavior, timestamp, ord FROM d WHERE rn = 1""",
    "filter_behavior": f"WITH {RAW_CTE} SELECT * FROM raw WHERE behavior IN ('pv', 'fav', 'cart', 'buy')",
    "filter_date_range": f"""WITH {RAW_CTE}
SELECT * FROM raw WHERE make_timestamp((timestamp + 28800) * 1000000) >= TIMESTAMP '2024-01-03 00:00:00'
  AND make_timestamp((timestamp + 28800) * 1000000) < TIMESTAMP '2024-01-26 00:00:00'""",
    "coerce_ids": f"""WITH {RAW_CTE},
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM raw)
SELECT coalesce(TRY_CAST(user_id AS INTEGER), -1) AS user_id, coalesce(TRY_CAST(item_id AS INTEGER), -1) AS item_id,
       coalesce(TRY_CAST(category_id AS INTEGER), -1) AS category_id,
       coalesce(TRY_CAST(ord * 1000000 AS INTEGER), -1) AS ord_id, behavior
FROM d WHERE rn = 1 AND behavior IN ('pv', 'fav', 'cart', 'buy')""",
    "clean_events": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "clean_events_after_filter": f"""WITH {RAW_CTE},
v AS (SELECT *, make_timestamp((timestamp + 28800) * 1000000) AS datetime FROM raw
      WHERE behavior IN ('pv', 'fav', 'cart', 'buy')),
w AS (SELECT * FROM v WHERE datetime >= TIMESTAMP '2024-01-03 00:00:00' AND datetime < TIMESTAMP '2024-01-26 00:00:00'),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM w)
SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id,
       CAST(category_id AS INTEGER) AS category_id, behavior, timestamp, datetime,
       strftime(datetime, '%Y-%m-%d') AS date,
       CAST(hour(datetime) AS TINYINT) AS hour, CAST(isodow(datetime) - 1 AS TINYINT) AS weekday
FROM d WHERE rn = 1""",
    "cleaning_overview": f"""WITH {CLEAN_CTE}
SELECT count(*) AS final_rows,
       CAST(count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS BIGINT) AS user_count,
       CAST(count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INTEGER)) AS BIGINT) AS item_count,
       CAST(count(DISTINCT category_id) + max(CAST(category_id IS NULL AS INTEGER)) AS BIGINT) AS category_count,
       strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(datetime), '%Y-%m-%d %H:%M:%S') AS "end"
FROM cleaned""",
    "behavior_counts": f"WITH {CLEAN_CTE} SELECT behavior, count(*) AS rows FROM cleaned GROUP BY behavior ORDER BY behavior",
    "cleaning_audit": f"""WITH {CLEAN_CTE},
a AS (SELECT count(*) AS raw_rows,
             count_if(behavior IN ('pv', 'fav', 'cart', 'buy')) AS after_behavior_filter_rows,
             count_if(behavior IN ('pv', 'fav', 'cart', 'buy') AND NOT (
                 make_timestamp((timestamp + 28800) * 1000000) >= TIMESTAMP '2024-01-03 00:00:00'
                 AND make_timestamp((timestamp + 28800) * 1000000) < TIMESTAMP '2024-01-26 00:00:00')) AS out_of_range_rows
      FROM raw),
f AS (SELECT count(*) AS final_rows FROM cleaned)
SELECT CAST(raw_rows AS BIGINT) AS raw_rows, CAST(after_behavior_filter_rows AS BIGINT) AS after_behavior_filter_rows,
       CAST(out_of_range_rows AS BIGINT) AS out_of_range_rows,
       CAST(after_behavior_filter_rows - out_of_range_rows AS BIGINT) AS after_date_filter_rows,
       CAST(raw_rows - after_behavior_filter_rows AS BIGINT) AS invalid_behavior_rows,
       CAST(final_rows AS BIGINT) AS final_rows,
       CAST(greatest(after_behavior_filter_rows - out_of_range_rows - final_rows, 0) AS BIGINT) AS global_duplicate_rows,
       CAST(greatest(raw_rows - final_rows, 0) AS BIGINT) AS total_removed_rows
FROM a, f""",
    "cleaning_stage_counts": f"""WITH {RAW_CTE},
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, timestamp ORDER BY ord) AS rn FROM raw),
w AS (SELECT * FROM d WHERE rn = 1),
s AS (SELECT (SELECT count(*) FROM raw) AS raw_rows, count(*) AS after_dedup_rows,
             count_if(behavior IN ('pv', 'fav', 'cart', 'buy')) AS after_behavior_filter_rows,
             count_if(behavior IN ('pv', 'fav', 'cart', 'buy') AND timestamp + 28800 >= epoch(TIMESTAMP '2024-01-03 00:00:00')
                      AND timestamp + 28800 < epoch(TIMESTAMP '2024-01-26 00:00:00')) AS after_date_filter_rows
      FROM w)
SELECT CAST(raw_rows AS BIGINT) AS raw_rows, CAST(after_dedup_rows AS BIGINT) AS after_dedup_rows,
       CAST(after_behavior_filter_rows AS BIGINT) AS after_behavior_filter_rows,
       CAST(after_date_filter_rows AS BIGINT) AS after_date_filter_rows,
       CAST(raw_rows - after_dedup_rows AS BIGINT) AS duplicate_rows,
       CAST(after_dedup_rows - after_behavior_filter_rows AS BIGINT) AS invalid_behavior_rows,
       CAST(after_behavior_filter_rows - after_date_filter_rows AS BIGINT) AS out_of_range_rows
FROM s""",
    "overview": f"""WITH {CLEAN_CTE}
SELECT count(*) AS final_rows,
       CAST(count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS BIGINT) AS user_count,
       CAST(count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INTEGER)) AS BIGINT) AS item_count,
       strftime(min(datetime), '%Y-%m-%d') AS first_day, strftime(max(datetime), '%Y-%m-%d') AS last_day
FROM cleaned""",
    "roundtrip_cleaned": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "scan_cleaned": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "load_cleaned": f"WITH {CLEAN_CTE} SELECT user_id, item_id, category_id, behavior, datetime FROM cleaned",
    "read_table": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    # funnel
    "first_touch": f"""WITH {FUNNEL_CTE}
SELECT user_id, behavior, min(timestamp) AS first_time FROM fe
WHERE behavior IN ('pv', 'fav', 'cart', 'buy') AND user_id IS NOT NULL GROUP BY user_id, behavior""",
    "funnel_step_join": f"WITH {FUNNEL_CTE} SELECT user_id, t AS fav_time FROM s2",
    "funnel": f"WITH {FUNNEL_CTE} SELECT * FROM funnel ORDER BY step",
    "funnel_users": f"WITH {USER_FUNNEL_CTE} SELECT * FROM funnel ORDER BY step",
    "daily_conversion": f"WITH {CLEAN_CTE} {conversion_sql('date')}",
    "hourly_conversion": f"WITH {CLEAN_CTE} {conversion_sql('hour')}",
    "daily_selected": f"""WITH {CLEAN_CTE}, daily AS ({conversion_sql('date')})
SELECT * FROM daily WHERE date IN ('2024-01-06', '2024-01-07', '2024-01-13', '2024-01-14', '2024-01-20', '2024-01-21')
ORDER BY date""",
    "funnel_flows": f"""WITH {FUNNEL_CTE}
SELECT * FROM (SELECT step, label AS source, lead(label) OVER (ORDER BY step) AS target,
                      least(uv, lead(uv) OVER (ORDER BY step)) AS value FROM funnel)
WHERE target IS NOT NULL ORDER BY step""",
    "funnel_overall": f"""WITH {FUNNEL_CTE}
SELECT max(CASE WHEN behavior = 'pv' THEN uv END) AS first_uv, max(CASE WHEN behavior = 'buy' THEN uv END) AS last_uv,
       coalesce(CAST(max(CASE WHEN behavior = 'buy' THEN uv END) AS DOUBLE)
                / nullif(max(CASE WHEN behavior = 'pv' THEN uv END), 0), 0.0) AS overall_buy_conversion_rate
FROM funnel""",
    "funnel_summary": f"""WITH {FUNNEL_CTE}, daily AS ({conversion_sql('date')}), hourly AS ({conversion_sql('hour')})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM funnel) AS funnel_steps,
       (SELECT CAST(count(*) AS BIGINT) FROM daily) AS daily_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM hourly) AS hourly_rows,
       (SELECT coalesce(CAST(max(CASE WHEN behavior = 'buy' THEN uv END) AS DOUBLE)
                / nullif(max(CASE WHEN behavior = 'pv' THEN uv END), 0), 0.0) FROM funnel) AS overall_buy_conversion_rate""",
    "summary_roundtrip": f"WITH {FUNNEL_CTE} SELECT * FROM funnel ORDER BY step",
}


# ------------------------------------------------------------------ RFM

ORDER_BUYS = """SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, p.p_brand AS category_id, o.o_orderdate AS datetime
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {status}
  LEFT JOIN part p ON l.l_partkey = p.p_partkey"""

SEGMENTS = """CASE CAST(r_level AS INTEGER) * 100 + CAST(f_level AS INTEGER) * 10 + CAST(m_level AS INTEGER)
  WHEN 111 THEN '一般挽留用户' WHEN 112 THEN '一般保持用户' WHEN 121 THEN '一般发展用户' WHEN 122 THEN '一般价值用户'
  WHEN 211 THEN '重要挽留用户' WHEN 212 THEN '重要保持用户' WHEN 221 THEN '重要发展用户' WHEN 222 THEN '重要价值用户' END"""


def rfm_base_cte(buys_sql: str, end_ts: str, monetary: str = "category_count") -> str:
    """CTEs ``buys`` and ``rfm0`` (unscored RFM)."""
    return f"""buys AS ({buys_sql}),
base AS (SELECT user_id, max(datetime) AS last_buy_time, count(item_id) AS frequency,
                count(DISTINCT category_id) AS category_count FROM buys GROUP BY user_id),
rfm0 AS (SELECT user_id, last_buy_time, CAST(frequency AS BIGINT) AS frequency,
                CAST(category_count AS BIGINT) AS category_count,
                CAST(greatest(floor((epoch(TIMESTAMP '{end_ts}') - epoch(last_buy_time)) / 86400), 0) AS BIGINT) AS recency,
                CAST({monetary} AS BIGINT) AS monetary
         FROM base)"""


def rfm_score_cte(src: str = "rfm0", out: str = "scored") -> str:
    """Tercile scores by the closed-form rule over unique ranks, median levels, segments."""
    def tercile(rank: str) -> str:
        return f"(CASE WHEN {rank} <= (n + 1) // 3 THEN 1 WHEN {rank} <= (n + 1) // 3 + n // 3 THEN 2 ELSE 3 END)"
    return f"""st_{out} AS (SELECT count(*) AS n, count(DISTINCT recency) AS rd, median(recency) AS rmed,
                count(DISTINCT frequency) AS fd, median(frequency) AS fmed,
                count(DISTINCT monetary) AS md, median(monetary) AS mmed FROM {src}),
rk_{out} AS (SELECT s.*, row_number() OVER (ORDER BY recency, user_id) AS rr,
                row_number() OVER (ORDER BY frequency, user_id) AS fr,
                row_number() OVER (ORDER BY monetary, user_id) AS mr FROM {src} s),
lv_{out} AS (SELECT rk_{out}.*, st_{out}.*,
                CAST(CASE WHEN recency <= rmed THEN 2 ELSE 1 END AS TINYINT) AS r_level,
                CAST(CASE WHEN frequency >= fmed THEN 2 ELSE 1 END AS TINYINT) AS f_level,
                CAST(CASE WHEN monetary >= mmed THEN 2 ELSE 1 END AS TINYINT) AS m_level
         FROM rk_{out}, st_{out}),
{out} AS (SELECT user_id, last_buy_time, frequency, category_count, recency, monetary,
                CAST(CASE WHEN rd < 3 THEN r_level ELSE 4 - {tercile('rr')} END AS TINYINT) AS r_score,
                CAST(CASE WHEN fd < 3 THEN f_level ELSE {tercile('fr')} END AS TINYINT) AS f_score,
                CAST(CASE WHEN md < 3 THEN m_level ELSE {tercile('mr')} END AS TINYINT) AS m_score,
                r_level, f_level, m_level, {SEGMENTS} AS segment
         FROM lv_{out})"""


def orders_scored(status: str | None = None, monetary: str = "category_count") -> str:
    st = f"AND o.o_orderstatus = '{status}'" if status else ""
    return rfm_base_cte(ORDER_BUYS.format(status=st), "2001-08-02 00:00:00", monetary) + ",\n" + rfm_score_cte()


def rfm_summary_sql(src: str = "scored") -> str:
    return f"""SELECT segment, CAST(user_count AS BIGINT) AS user_count,
       round_even(CAST(user_count AS DOUBLE) / sum(user_count) OVER () * 100.0, 2) AS user_ratio,
       CAST(sum(du) OVER () AS BIGINT) AS total_buy_users
FROM (SELECT segment, count(*) AS user_count, count(DISTINCT user_id) AS du FROM {src} GROUP BY segment)"""


def histogram_sql(src: str = "scored") -> str:
    parts = []
    for m in ("recency", "frequency", "monetary"):
        parts.append(f"""(WITH p AS (SELECT CAST(CASE WHEN min({m}) = max({m}) THEN min({m}) - 0.5 ELSE min({m}) END AS DOUBLE) AS lo,
                  CAST(CASE WHEN min({m}) = max({m}) THEN max({m}) + 0.5 ELSE max({m}) END AS DOUBLE) AS hi,
                  CAST(least(20, greatest(3, count(DISTINCT {m}))) AS INTEGER) AS bins FROM {src}),
      x AS (SELECT CAST(s.{m} AS DOUBLE) AS x, lo, hi, bins, (hi - lo) / bins AS step FROM {src} s, p),
      i0 AS (SELECT x, lo, hi, bins, step,
                    least(CAST(floor((x - lo) / (hi - lo) * CAST(bins AS DOUBLE)) AS INTEGER), bins - 1) AS i FROM x),
      i1 AS (SELECT x, lo, hi, bins, step, CASE WHEN x < CAST(i AS DOUBLE) * step + lo THEN i - 1 ELSE i END AS i FROM i0),
      i2 AS (SELECT CASE WHEN x >= CAST(i + 1 AS DOUBLE) * step + lo AND i <> bins - 1 THEN i + 1 ELSE i END AS bin FROM i1),
      c AS (SELECT bin, count(*) AS users FROM i2 GROUP BY bin),
      b AS (SELECT CAST(g.generate_series AS INTEGER) AS bin, lo, hi, bins, (hi - lo) / bins AS step
            FROM p, generate_series(0, (SELECT bins FROM p) - 1) g)
 SELECT '{m}' AS metric, b.bin, round_even(CAST(b.bin AS DOUBLE) * step + lo, 6) AS lower,
        round_even(CASE WHEN b.bin = bins - 1 THEN hi ELSE CAST(b.bin + 1 AS DOUBLE) * step + lo END, 6) AS upper,
        CAST(coalesce(c.users, 0) AS BIGINT) AS users
 FROM b LEFT JOIN c ON b.bin = c.bin)""")
    return " UNION ALL ".join(parts)


EVENTS_BUYS = "SELECT user_id, item_id, category_id, datetime FROM cleaned WHERE behavior = 'buy'"

SQL.update({
    "buy_events": f"WITH {CLEAN_CTE} SELECT user_id, item_id, category_id, behavior, datetime FROM cleaned WHERE behavior = 'buy'",
    "rfm_table": f"WITH {orders_scored()} SELECT * FROM scored",
    "rfm_events": f"WITH {CLEAN_CTE}, {rfm_base_cte(EVENTS_BUYS, '2024-01-26 00:00:00')}, {rfm_score_cte()} SELECT * FROM scored",
    "rfm_table_freq_mode": f"WITH {orders_scored(monetary='frequency')} SELECT * FROM scored",
    "rfm_rank": f"""WITH {rfm_base_cte(ORDER_BUYS.format(status=''), '2001-08-02 00:00:00')}
SELECT user_id, recency, frequency, monetary,
       row_number() OVER (ORDER BY recency, user_id) AS recency_rank,
       row_number() OVER (ORDER BY frequency, user_id) AS frequency_rank,
       row_number() OVER (ORDER BY monetary, user_id) AS monetary_rank FROM rfm0""",
    "rfm_scores": f"WITH {orders_scored()} SELECT user_id, r_score, f_score, m_score FROM scored",
    "rfm_scores_status_f": f"WITH {orders_scored('F')} SELECT user_id, r_score, f_score, m_score FROM scored",
    "rfm_scores_status_o": f"WITH {orders_scored('O')} SELECT user_id, r_score, f_score, m_score FROM scored",
    "rfm_levels": f"""WITH {rfm_base_cte(ORDER_BUYS.format(status=''), '2001-08-02 00:00:00')},
st AS (SELECT median(recency) AS rmed, median(frequency) AS fmed, median(monetary) AS mmed FROM rfm0)
SELECT user_id, CAST(CASE WHEN recency <= rmed THEN 2 ELSE 1 END AS TINYINT) AS r_level,
       CAST(CASE WHEN frequency >= fmed THEN 2 ELSE 1 END AS TINYINT) AS f_level,
       CAST(CASE WHEN monetary >= mmed THEN 2 ELSE 1 END AS TINYINT) AS m_level,
       CAST(rmed AS DOUBLE) AS recency_median, CAST(fmed AS DOUBLE) AS frequency_median,
       CAST(mmed AS DOUBLE) AS monetary_median
FROM rfm0, st""",
    "rfm_segments": f"WITH {orders_scored()} SELECT user_id, r_level, f_level, m_level, segment FROM scored",
    "rfm_summary": f"WITH {orders_scored()} {rfm_summary_sql()}",
    "rfm_document": f"""WITH {orders_scored()}, s AS ({rfm_summary_sql()}),
m AS (SELECT segment, round_even(avg(recency), 2) AS recency, round_even(avg(frequency), 2) AS frequency,
             round_even(avg(monetary), 2) AS monetary FROM scored GROUP BY segment)
SELECT total_buy_users, segment, user_count, user_ratio, recency, frequency, monetary FROM s JOIN m USING (segment)""",
    "rfm_segment_means": f"""WITH {orders_scored()}
SELECT segment, round_even(avg(recency), 2) AS recency, round_even(avg(frequency), 2) AS frequency,
       round_even(avg(monetary), 2) AS monetary FROM scored GROUP BY segment ORDER BY avg(frequency) DESC, segment""",
    "rfm_histogram": f"WITH {orders_scored()} {histogram_sql()}",
    "rfm_kpis": f"""WITH {orders_scored()}
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS buy_users, round_even(avg(frequency), 2) AS mean_frequency,
       round_even(avg(monetary), 2) AS mean_monetary FROM scored""",
    "rfm_what_if": f"""WITH {orders_scored()},
shifted AS (SELECT user_id, last_buy_time, frequency, category_count,
                   CAST(greatest(recency - 2, 0) AS BIGINT) AS recency, monetary FROM scored),
{rfm_score_cte('shifted', 'rescored')}
{rfm_summary_sql('rescored')}""",
    "rfm_top_users": f"""WITH {orders_scored()}
SELECT user_id, segment, recency, frequency, monetary, r_score, f_score, m_score FROM scored
ORDER BY segment, frequency DESC, user_id LIMIT 200""",
})


# ------------------------------------------------------------------ clustering

LEVEL_LABELLED = orders_scored() + """,
lc AS (SELECT user_id, recency, frequency, monetary,
              CAST((CAST(r_level AS INTEGER) - 1) * 4 + (CAST(f_level AS INTEGER) - 1) * 2
                   + (CAST(m_level AS INTEGER) - 1) AS INTEGER) AS cluster FROM scored),
cm AS (SELECT cluster, count(user_id) AS user_count, avg(recency) AS recency, avg(frequency) AS frequency,
              avg(monetary) AS monetary FROM lc GROUP BY cluster),
lab AS (SELECT cluster,
               CASE WHEN fr = 1 AND mr = 1 THEN '高价值高活跃群体' WHEN rr = 1 THEN '近期活跃潜力群体'
                    WHEN fr >= nc THEN '低频沉默群体' ELSE '稳定发展群体' END AS cluster_label
        FROM (SELECT cluster, dense_rank() OVER (ORDER BY frequency DESC) AS fr,
                     dense_rank() OVER (ORDER BY recency) AS rr, dense_rank() OVER (ORDER BY monetary DESC) AS mr,
                     count(*) OVER () AS nc FROM cm)),
labelled AS (SELECT lc.user_id, lc.recency, lc.frequency, lc.monetary, lc.cluster, lab.cluster_label
             FROM lc LEFT JOIN lab ON lc.cluster = lab.cluster),
lm AS (SELECT cluster, cluster_label, count(user_id) AS user_count, avg(recency) AS recency,
              avg(frequency) AS frequency, avg(monetary) AS monetary FROM labelled GROUP BY cluster, cluster_label)"""


def _minmax(m: str) -> str:
    return (f"round_even(CASE WHEN max({m}) OVER () - min({m}) OVER () = 0 THEN 0.0 "
            f"ELSE ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END, 6) AS {m}")


Z_STATS = """st AS (SELECT avg(recency) AS recency_mean, stddev_pop(recency) AS recency_std,
              avg(frequency) AS frequency_mean, stddev_pop(frequency) AS frequency_std,
              avg(monetary) AS monetary_mean, stddev_pop(monetary) AS monetary_std FROM scored)"""


def _z(m: str) -> str:
    return f"round_even(({m} - {m}_mean) / CASE WHEN {m}_std = 0 THEN 1.0 ELSE {m}_std END, 6) AS z_{m}"


SQL.update({
    "cluster_features": f"""WITH {orders_scored()},
st AS (SELECT avg(recency) AS recency_mean, stddev_pop(recency) AS recency_std,
              avg(frequency) AS frequency_mean, stddev_pop(frequency) AS frequency_std,
              avg(monetary) AS monetary_mean, stddev_pop(monetary) AS monetary_std FROM scored)
SELECT user_id, recency, frequency, monetary, {_z('recency')}, {_z('frequency')}, {_z('monetary')} FROM scored, st""",
    "cluster_certificate": f"""WITH {orders_scored()},
st AS (SELECT count(*) AS n, var_pop(recency) > 0 AS r, var_pop(frequency) > 0 AS f, var_pop(monetary) > 0 AS m FROM scored)
SELECT CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS users, round_even(CAST(n * (r::INTEGER + f::INTEGER + m::INTEGER) AS DOUBLE), 4) AS total,
       true AS adds_up, CAST(0 AS BIGINT) AS misplaced FROM st, range(2, 9) t(k) WHERE k <= n AND n >= 2""",
    "cluster_sample": f"""WITH {orders_scored()}, {Z_STATS}
SELECT user_id, recency, frequency, monetary, {_z('recency')}, {_z('frequency')}, {_z('monetary')} FROM scored, st
ORDER BY md5('42:' || user_id), user_id LIMIT 100""",
    "cluster_pca": f"""WITH {orders_scored()}, {Z_STATS},
m AS (SELECT corr(recency, frequency) AS a, corr(recency, monetary) AS b, corr(frequency, monetary) AS c FROM scored),
-- eigenvalues of [[1, a, b], [a, 1, c], [b, c, 1]]: 1 + 2p cos(angle + 2 pi j / 3); eigenvectors are cross products of two rows
e AS (SELECT a, b, c, sqrt((a * a + b * b + c * c) / 3) AS p FROM m),
g AS (SELECT *, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS angle FROM e),
v AS (SELECT i, a, b, c, 2 * p * cos(angle + CASE WHEN i = 1 THEN 0 ELSE 4 * pi() / 3 END) AS d FROM g, range(1, 3) t(i)),
x AS (SELECT i, [a * c + b * d, a * b + c * d, d * d - a * a] AS x FROM v),
u AS (SELECT i, list_transform(x, lambda y: y / sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3])) AS u FROM x),
s AS (SELECT i, list_transform(u, lambda y: y * sign(u[list_position(list_transform(u, lambda t: round(abs(t), 9)),
  list_max(list_transform(u, lambda t: round(abs(t), 9))))])) AS s FROM u),
z AS (SELECT user_id, recency, frequency, monetary, (recency - recency_mean) / recency_std AS zr, (frequency - frequency_mean) / frequency_std AS zf,
  (monetary - monetary_mean) / monetary_std AS zm FROM scored, st)
SELECT user_id, recency, frequency, monetary, round_even(zr * p.s[1] + zf * p.s[2] + zm * p.s[3], 6) AS pca_1,
       round_even(zr * q.s[1] + zf * q.s[2] + zm * q.s[3], 6) AS pca_2 FROM z, s p, s q WHERE p.i = 1 AND q.i = 2""",
    "cluster_labels": f"WITH {LEVEL_LABELLED} SELECT * FROM labelled",
    "cluster_summary": f"""WITH {LEVEL_LABELLED}
SELECT cluster, cluster_label, CAST(user_count AS BIGINT) AS user_count, round_even(recency, 2) AS recency,
       round_even(frequency, 2) AS frequency, round_even(monetary, 2) AS monetary,
       round_even(CAST(user_count AS DOUBLE) / sum(user_count) OVER () * 100.0, 2) AS user_ratio
FROM lm ORDER BY cluster""",
    "cluster_profile": f"""WITH {LEVEL_LABELLED}
SELECT cluster, cluster_label, {_minmax('recency')}, {_minmax('frequency')}, {_minmax('monetary')} FROM lm ORDER BY cluster""",
    "cluster_label_share": f"""WITH {LEVEL_LABELLED}
SELECT cluster_label, CAST(count(*) AS BIGINT) AS user_count FROM labelled GROUP BY cluster_label""",
})


SQL.update({
    "stream_clean": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "stream_clean_unbounded": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "stream_counts": f"""WITH {CLEAN_CTE}
SELECT behavior, count(*) AS rows, min(datetime) AS min_datetime, max(datetime) AS max_datetime
FROM cleaned GROUP BY behavior""",
})


SQL.update({
    "rfm_stored": f"WITH {orders_scored()} SELECT * FROM scored",
    "load_cleaned_batches": f"WITH {CLEAN_CTE} SELECT behavior, CAST(count(*) AS BIGINT) AS rows FROM cleaned GROUP BY behavior",
    "compacted_cleaned": f"WITH {CLEAN_CTE} {CLEANED_SELECT}",
    "cleaning_summary_roundtrip": f"""WITH {CLEAN_CTE},
c AS (SELECT count(*) AS final_rows, count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS user_count,
             count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INTEGER)) AS item_count,
             count(DISTINCT category_id) + max(CAST(category_id IS NULL AS INTEGER)) AS category_count,
             strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(datetime), '%Y-%m-%d %H:%M:%S') AS "end"
      FROM cleaned),
r AS (SELECT count(*) AS raw_rows FROM raw),
b AS (SELECT behavior, count(*) AS rows FROM cleaned GROUP BY behavior)
SELECT CAST(raw_rows AS BIGINT) AS raw_rows, CAST(final_rows AS BIGINT) AS final_rows,
       CAST(user_count AS BIGINT) AS user_count, CAST(item_count AS BIGINT) AS item_count,
       CAST(category_count AS BIGINT) AS category_count,
       CAST(greatest(raw_rows - final_rows, 0) AS BIGINT) AS total_removed_rows, start, "end",
       behavior, CAST(rows AS BIGINT) AS rows
FROM c, r, b""",
})

SQL["stream_clean_ordered"] = f"WITH {CLEAN_CTE} {CLEANED_SELECT}"

SQL["cleaning_overview_merged"] = SQL["cleaning_overview"]
SQL["overview_stored"] = SQL["overview"]
SQL["load_cleaned_csv"] = SQL["load_cleaned_parts"] = SQL["load_cleaned"]
SQL["load_cleaned_by_date"] = f"WITH {CLEAN_CTE} SELECT user_id, item_id, category_id, behavior, datetime, date FROM cleaned"
SQL["cleaning_overview_by_day"] = f"""WITH {CLEAN_CTE}
SELECT date, count(*) AS final_rows,
       CAST(count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS BIGINT) AS user_count,
       CAST(count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INTEGER)) AS BIGINT) AS item_count,
       CAST(count(DISTINCT category_id) + max(CAST(category_id IS NULL AS INTEGER)) AS BIGINT) AS category_count,
       strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(datetime), '%Y-%m-%d %H:%M:%S') AS "end"
FROM cleaned GROUP BY date"""
SQL["cluster_document"] = f"""WITH {LEVEL_LABELLED},
whole AS (SELECT var_pop(recency) AS r, var_pop(frequency) AS f, var_pop(monetary) AS m FROM labelled),
per AS (SELECT count(*) AS n, var_pop(recency) AS r, var_pop(frequency) AS f, var_pop(monetary) AS m FROM labelled GROUP BY cluster),
e AS (SELECT CAST(count(*) AS INTEGER) AS elbow_k, sum(n * (CASE WHEN whole.r > 0 THEN per.r / whole.r ELSE 0 END
  + CASE WHEN whole.f > 0 THEN per.f / whole.f ELSE 0 END + CASE WHEN whole.m > 0 THEN per.m / whole.m ELSE 0 END)) AS inertia FROM per, whole)
SELECT CAST(count(*) OVER () AS BIGINT) AS cluster_count, CAST(5 AS INTEGER) AS selected_k, cluster, cluster_label,
       CAST(user_count AS BIGINT) AS user_count, round_even(recency, 2) AS recency, round_even(frequency, 2) AS frequency,
       round_even(monetary, 2) AS monetary, round_even(CAST(user_count AS DOUBLE) / sum(user_count) OVER () * 100.0, 2) AS user_ratio,
       elbow_k, round(inertia, 3) AS elbow_inertia
FROM lm, e"""
