"""A Spark-native store and query engine for device telemetry."""
