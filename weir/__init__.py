"""Spark-native unified content engine: landed web payloads in, one record table out."""
