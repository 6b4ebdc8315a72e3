"""Spark-native analytics over text corpora whose records carry ordered provenance chains."""
