"""Spark-first analytics over content and engagement data."""
