"""Delimited-text sources, catalog tables and the shared scratch folder."""
