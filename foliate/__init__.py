"""foliate: document structure at collection scale, on Spark."""
