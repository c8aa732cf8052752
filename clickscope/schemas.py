"""Declared table schemas: every table has one StructType, empty or not."""

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("behavior", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

CLEANED_COLUMNS = [
    "user_id", "item_id", "category_id", "behavior", "timestamp",
    "datetime", "date", "hour", "weekday",
]

CLEANED = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("behavior", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("date", T.StringType()),
        T.StructField("hour", T.ByteType()),
        T.StructField("weekday", T.ByteType()),
    ]
)

FUNNEL_ROW = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("behavior", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("uv", T.LongType()),
        T.StructField("independent_uv", T.LongType()),
        T.StructField("actions", T.LongType()),
        T.StructField("conversion_rate", T.DoubleType()),
        T.StructField("loss_rate", T.DoubleType()),
    ]
)

FUNNEL_SUMMARY = T.StructType(
    [
        T.StructField("funnel", T.ArrayType(FUNNEL_ROW)),
        T.StructField("daily_rows", T.LongType()),
        T.StructField("hourly_rows", T.LongType()),
        T.StructField("overall_buy_conversion_rate", T.DoubleType()),
    ]
)

CLEANING_SUMMARY = T.StructType(
    [
        T.StructField("raw_rows", T.LongType()),
        T.StructField("after_behavior_filter_rows", T.LongType()),
        T.StructField("after_date_filter_rows", T.LongType()),
        T.StructField("final_rows", T.LongType()),
        T.StructField("user_count", T.LongType()),
        T.StructField("item_count", T.LongType()),
        T.StructField("category_count", T.LongType()),
        T.StructField("invalid_behavior_rows", T.LongType()),
        T.StructField("out_of_range_rows", T.LongType()),
        T.StructField("global_duplicate_rows", T.LongType()),
        T.StructField("total_removed_rows", T.LongType()),
        T.StructField("behavior_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField(
            "date_range",
            T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]),
        ),
    ]
)

RFM_DOCUMENT = T.StructType([
    T.StructField("total_buy_users", T.LongType()),
    T.StructField("segment_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("segment_ratio", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("rfm_mean_by_segment", T.MapType(T.StringType(), T.StructType(
        [T.StructField(c, T.DoubleType()) for c in ("recency", "frequency", "monetary")]))),
])

CLUSTER_DOCUMENT = T.StructType([
    T.StructField("cluster_count", T.LongType()),
    T.StructField("selected_k", T.IntegerType()),
    T.StructField("clusters", T.ArrayType(T.StructType(
        [T.StructField("cluster", T.IntegerType()), T.StructField("cluster_label", T.StringType()), T.StructField("user_count", T.LongType()),
         *[T.StructField(c, T.DoubleType()) for c in ("recency", "frequency", "monetary", "user_ratio")]]))),
    T.StructField("elbow", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("inertia", T.DoubleType())]))),
])
