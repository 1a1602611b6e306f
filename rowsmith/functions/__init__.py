"""Column-level helpers built from Spark's own functions."""
