"""Memory-consolidation analytics as composable Spark DataFrame operations."""
