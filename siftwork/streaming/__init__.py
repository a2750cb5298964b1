"""Structured Streaming forms of the polled workers, and event-time windows."""
