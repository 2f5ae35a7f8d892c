"""All queries by name, and the SQL that gives the same rows."""

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
