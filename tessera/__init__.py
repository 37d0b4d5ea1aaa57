"""Retrieval over document tables and its measurement, as Spark DataFrame operations."""
