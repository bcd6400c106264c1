"""Spark-native building and delivery tracking of web text corpora."""
