"""Incremental versions of the loads and rollups on Structured Streaming."""

from meterflow.streaming.flows import (  # noqa: F401
    daily_view_stream,
    dedup_stream,
    delta_stream,
    ingest_stream,
    late_rows,
    rollup_stream,
    run,
)
