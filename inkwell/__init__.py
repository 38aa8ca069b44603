"""A Spark engine for documentation research artifacts."""
