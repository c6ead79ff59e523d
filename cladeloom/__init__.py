"""Spark-native k-mer family assignment and tree placement."""
