"""Spark-native engine that cleans, aligns, merges and analyses repeatedly extracted tables."""
