"""The registered queries and their SQL for DuckDB, by name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.plans.adapters import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function (spark, sf_dir) -> DataFrame, and its SQL over the named views."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at a fixed scale, for a comparison by value."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
