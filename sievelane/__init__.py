"""Sievelane: Spark-native preparation, audit and evaluation of text-model datasets."""
