"""Civic-records analytics on Spark: text structure, search, facts, metrics and label checks."""
