"""Process-video telemetry analytics on Spark."""
