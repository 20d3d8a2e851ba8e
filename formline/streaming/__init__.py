"""Incremental detectors on Structured Streaming."""
