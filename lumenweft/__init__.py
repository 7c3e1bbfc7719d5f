"""Spark-native affinity search and record curation engine."""
