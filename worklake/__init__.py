"""worklake: agent-telemetry analytics as Spark DataFrame jobs."""
