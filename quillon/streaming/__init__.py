"""The engine's operators over unbounded input."""

from quillon.streaming.events import parquet_stream, run_to_memory, session_counts, windowed_counts

__all__ = ["parquet_stream", "run_to_memory", "session_counts", "windowed_counts"]
