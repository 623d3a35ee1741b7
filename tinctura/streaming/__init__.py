"""Structured Streaming forms of counters, events and best scores."""
