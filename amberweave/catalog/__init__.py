"""Registry of the library's queries and the SQL that gives the same rows."""

from . import graphs, hierarchy, policies, search, sharing, stores, texts, vectors
from .common import ORACLE, QUERIES

__all__ = ["graphs", "hierarchy", "policies", "search", "sharing", "stores", "texts", "vectors"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
