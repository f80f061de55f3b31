"""Spark-native analytics over conversation transcripts and the records extracted from them."""
