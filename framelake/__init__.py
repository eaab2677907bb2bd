"""Spark-native analytics over video-codec telemetry."""
