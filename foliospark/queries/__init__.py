"""Registered queries over whole tables, by name, and their SQL."""

from foliospark.queries import documents, families, rules
from foliospark.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "families", "rules"]
