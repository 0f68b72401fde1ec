"""Queries of the tabular operators over the test tables, with the SQL that must give the same rows."""

from .tabular import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
