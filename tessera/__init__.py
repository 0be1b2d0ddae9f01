"""Spark-native analytics over two-dimensional sensor mosaics and their logs."""
