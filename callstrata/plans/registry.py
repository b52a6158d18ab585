"""Registration of queries and assembly of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callstrata.plans.fixtures import CTE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of additions does not show; a negative zero becomes zero."""
    return df.withColumns({
        f.name: F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, T.DoubleType)
    }) if any(isinstance(f.dataType, T.DoubleType) for f in df.schema) else df


def with_views(sql: str) -> str:
    """Prefix the views a statement names, in the order of their definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in CTE if n in needed)
    if sql.lstrip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    return f"WITH {head} {sql}"


def query(name: str, sql: str | None = None, dbl: str = ""):
    """Register ``fn(views) -> DataFrame`` and, where SQL can state it, the SQL of the same rows.

    ``dbl`` names the double columns; they are rounded alike on both sides.
    """
    def deco(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Views(spark, sf_dir)))
        if sql is not None:
            if dbl:
                cols = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0::DOUBLE AS {c}" for c in dbl.split())
                text = f"SELECT * REPLACE ({cols}) FROM ({sql})"
            else:
                text = sql
            ORACLES[name] = with_views(text)
        return fn
    return deco
