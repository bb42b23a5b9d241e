"""Relational, time-series, feature, model and metric operators on DataFrames."""
