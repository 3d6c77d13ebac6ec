"""Tidemark: timed-text, frame and request-log analytics as Spark DataFrame jobs."""
