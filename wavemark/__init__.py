"""Spark-native analytics of multivariate telemetry."""
