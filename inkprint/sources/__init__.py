"""Readers that yield corpus rows, and the sinks of the jobs."""
