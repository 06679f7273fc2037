"""Spark-first analytics for long-term agent memory tables."""
