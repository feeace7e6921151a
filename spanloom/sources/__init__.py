"""Batch sources, table scans and sinks."""
