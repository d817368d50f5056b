"""Spark jobs that tell human-written from machine-written prose at corpus scale."""
