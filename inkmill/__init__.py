"""Spark-native preparation, packing and scoring of language-model text corpora."""
