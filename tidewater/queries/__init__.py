"""Registered queries over the given tables, and the SQL that each is held against."""

from tidewater.queries import detection, features, further, modelling, series, summaries
from tidewater.queries._base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "detection", "features", "further", "modelling", "series", "summaries"]
