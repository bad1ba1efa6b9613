"""Queries over the driver's tables, and the SQL to hold them against."""
