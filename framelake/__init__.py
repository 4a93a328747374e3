"""Spark-first analytics over object-detection events and large text corpora."""
