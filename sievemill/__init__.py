"""Spark-native construction, scoring, selection, splitting and audit of corpora."""
