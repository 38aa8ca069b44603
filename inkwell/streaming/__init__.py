"""Structured Streaming: ingest into the versioned store, windows over events, freshness by timer."""
