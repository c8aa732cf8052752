"""Job parameters.  Defaults are the values the analysed data set is defined with."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

# ---------------------------------------------------------------------------
# These must equal the source pipeline's constants for the
# results (labels, behavior names, dates) to match it.
# ---------------------------------------------------------------------------
VALID_BEHAVIORS = ("pv", "fav", "cart", "buy")
FUNNEL_LABELS = {"pv": "浏览", "fav": "收藏", "cart": "加购", "buy": "购买"}
DATE_RANGE = ("2017-11-25", "2017-12-03")
TIME_ZONE = "Asia/Shanghai"
UTC_OFFSET_HOURS = 8
ANALYSIS_END = "2017-12-04"
SCORE_BINS = 3
MONETARY_MODE = "category_count"
K_RANGE = (2, 8)
OPTIMAL_K = 5
SAMPLE_SIZE = 50_000
SEED = 42
SEGMENT_LABELS = {
    (1, 1, 1): "一般挽留用户",
    (1, 1, 2): "一般保持用户",
    (1, 2, 1): "一般发展用户",
    (1, 2, 2): "一般价值用户",
    (2, 1, 1): "重要挽留用户",
    (2, 1, 2): "重要保持用户",
    (2, 2, 1): "重要发展用户",
    (2, 2, 2): "重要价值用户",
}
CLUSTER_LABEL_TOP = "高价值高活跃群体"
CLUSTER_LABEL_RECENT = "近期活跃潜力群体"
CLUSTER_LABEL_SILENT = "低频沉默群体"
CLUSTER_LABEL_STEADY = "稳定发展群体"
# ---------------------------------------------------------------------------

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class CleanParams:
    """Parameters of ``clean_events``.

    ``tz_mode``: ``"fixed"`` adds ``utc_offset_hours`` to UTC (the default engine);
    ``"zone"`` converts to ``time_zone`` with its rules (the chunked engine).
    ``on_bad_id``: ``"fail"`` raises on a non-numeric or too large id, ``"minus_one"``
    replaces it by -1, ``"null"`` keeps null.
    ``dedup_scope``: ``"before_filter"`` (keep-first over all raw rows, default) or
    ``"after_filter"`` (dedup only rows that passed the behavior and date filters).
    """

    behaviors: tuple[str, ...] = VALID_BEHAVIORS
    start_date: str = DATE_RANGE[0]
    end_date: str = DATE_RANGE[1]  # inclusive day
    tz_mode: str = "fixed"
    utc_offset_hours: int = UTC_OFFSET_HOURS
    time_zone: str = TIME_ZONE
    dedup_key: tuple[str, ...] = ("user_id", "item_id", "timestamp")
    dedup_scope: str = "before_filter"
    on_bad_id: str = "fail"

    @property
    def start_local(self) -> datetime:
        return datetime.fromisoformat(self.start_date)

    @property
    def end_local_exclusive(self) -> datetime:
        return datetime.fromisoformat(self.end_date) + timedelta(days=1)

    def epoch_bounds(self) -> tuple[int, int]:
        """Half-open ``[lo, hi)`` epoch-second bounds equal to the local-date range
        under a fixed offset (used to push the range filter below the dedup)."""
        off = self.utc_offset_hours * 3600
        lo = int((self.start_local - EPOCH).total_seconds()) - off
        hi = int((self.end_local_exclusive - EPOCH).total_seconds()) - off
        return lo, hi


@dataclass(frozen=True)
class FunnelParams:
    """``hot_rows``: a user with more events of one behavior than this is split over
    ``ceil(n / hot_rows)`` salted join partitions; ``max_hot_users`` caps the broadcast
    hot-user table by raising the threshold to ``total / max_hot_users`` when needed."""

    steps: tuple[str, ...] = VALID_BEHAVIORS
    labels: dict = field(default_factory=lambda: dict(FUNNEL_LABELS))
    user_col: str = "user_id"
    time_col: str = "timestamp"
    hot_rows: int = 1_000_000
    max_hot_users: int = 100_000


@dataclass(frozen=True)
class RfmParams:
    analysis_end: str = ANALYSIS_END  # reference instant, local midnight
    score_bins: int = SCORE_BINS
    monetary_mode: str = MONETARY_MODE  # "category_count" or "frequency"
    buy_behavior: str = "buy"

    @property
    def end_instant(self) -> datetime:
        return datetime.fromisoformat(self.analysis_end)


@dataclass(frozen=True)
class ClusterParams:
    features: tuple[str, ...] = ("recency", "frequency", "monetary")
    k_range: tuple[int, int] = K_RANGE
    k: int = OPTIMAL_K
    seed: int = SEED
    max_iter: int = 300
    tol: float = 1e-4
    sample_size: int = SAMPLE_SIZE


def day_after(iso_day: str) -> str:
    return (date.fromisoformat(iso_day) + timedelta(days=1)).isoformat()
