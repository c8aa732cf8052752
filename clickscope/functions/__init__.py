"""Column expressions: all JVM-side Spark SQL functions, no Python UDFs."""

from clickscope.functions.numeric import clip_lower, guarded_ratio, half_even
from clickscope.functions.timefn import (
    date_string,
    elapsed_days,
    epoch_seconds,
    hour_of,
    local_datetime,
    ntz_literal,
    weekday_monday0,
)

__all__ = [
    "clip_lower", "guarded_ratio", "half_even", "date_string", "elapsed_days", "epoch_seconds",
    "hour_of", "local_datetime", "ntz_literal", "weekday_monday0",
]
