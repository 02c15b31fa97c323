"""Spark-native analytics for network-security telemetry of industrial control traffic."""
