"""Merge-impact analytics and corpus preparation on Spark."""
