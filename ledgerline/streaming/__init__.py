"""Incremental delivery of the order rollup with Structured Streaming."""

from ledgerline.streaming.feed import stream_sales_rollup

__all__ = ["stream_sales_rollup"]
