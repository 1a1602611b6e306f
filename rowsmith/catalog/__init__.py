"""Queries over the driver's tables, each next to the SQL that must give the same rows."""
