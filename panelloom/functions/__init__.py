"""Column functions: frequencies, date features, statistics."""
