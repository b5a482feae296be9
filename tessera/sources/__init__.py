"""Readers and writers, all through Spark's own formats."""
