"""Batch document retrieval, reporting and deck tools as Spark jobs."""
