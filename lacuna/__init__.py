"""Spark-native analysis of underdense regions in three-dimensional tracer catalogues."""
