"""Structured Streaming forms of change detection, retry state and telemetry."""
