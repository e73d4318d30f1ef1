"""The registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.adapters import PREFIX

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
TTL = 7_200_000
H1, H4, D1 = 3_600_000, 14_400_000, 86_400_000


def register(name: str, query: Callable, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = PREFIX.rstrip().rstrip(",") + (", " + sql[5:] if sql.startswith("WITH ") else "\n" + sql)


def R(c, digits: int = 4):
    """Round half away from zero after scaling; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits) / F.lit(10.0**digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, as sums differ in their last bits between engines."""
    return df.select(*[R(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
