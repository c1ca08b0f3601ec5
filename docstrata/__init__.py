"""Spark-native document retrieval analytics: every operator takes and returns DataFrames."""
