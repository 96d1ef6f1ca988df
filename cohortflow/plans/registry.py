"""Named queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver tables (through the fixture views) so its work
grows with them.  Each query module registers with ``register``; floats are
rounded to 6 places in both engines so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operator: str


QUERIES: dict[str, Query] = {}


def register(name: str, operator: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, operator)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (the oracle SQL rounds the same columns)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _load_all() -> None:
    from . import queries_core  # noqa: F401
    from . import queries_models  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: q.fn for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: q.sql for k, q in QUERIES.items() if q.sql}
