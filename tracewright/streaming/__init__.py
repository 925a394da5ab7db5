"""Structured Streaming operators: keyed state, record sinks, progress batches."""
