"""Runnable queries over the test tables, with their reference SQL."""
