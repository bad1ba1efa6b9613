"""Operators over detection tables of many matches, partitioned by match."""
