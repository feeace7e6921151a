"""Structured Streaming forms of ingest and dedupe."""
