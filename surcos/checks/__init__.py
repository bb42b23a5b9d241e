"""Registered queries, each next to the SQL that states the same result."""
