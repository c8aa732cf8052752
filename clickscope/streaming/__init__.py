"""Structured Streaming forms of the clean job."""

from clickscope.streaming.clean_stream import feed_batches, feed_files, stream_clean, stream_clean_ordered, stream_counts

__all__ = ["feed_batches", "feed_files", "stream_clean", "stream_clean_ordered", "stream_counts"]
