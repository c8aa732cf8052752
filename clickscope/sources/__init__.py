"""Readers, writers and the adapters that turn the given tables into click logs."""

from clickscope.sources.adapters import events_raw, funnel_events, orders_buy_events
from clickscope.sources.raw import ORDER_COL, raw_row_count, read_raw, read_raw_ordered, write_raw_csv
from clickscope.sources.tables import load_cleaned, read_table, scan_cleaned
from clickscope.sources.sinks import read_summary_json, write_cleaned, write_summary_json

__all__ = [
    "ORDER_COL", "events_raw", "funnel_events", "orders_buy_events", "raw_row_count", "read_raw",
    "read_raw_ordered", "write_raw_csv", "load_cleaned", "read_table", "scan_cleaned",
    "read_summary_json", "write_cleaned", "write_summary_json",
]
