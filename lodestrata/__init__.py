"""Lodestrata: evidence indexing, retrieval and training-data preparation on Spark."""
