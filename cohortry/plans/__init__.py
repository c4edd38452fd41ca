"""Ready queries over the given tables, each with the SQL it is checked against."""

from cohortry.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
