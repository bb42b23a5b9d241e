"""Importing this module registers every query."""

from surcos.checks import aggregates, catalog, features, models, properties, relational, series  # noqa: F401
from surcos.checks.registry import QUERIES, SQL  # noqa: F401
