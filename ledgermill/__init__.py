"""Entity analytics over transfer records and network telemetry, on Spark."""
