"""Spark-native analytics over text corpora and their link graphs."""
