"""Relations derived from the raw tables."""
