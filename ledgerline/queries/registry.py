"""Registration of checked queries.

A column of a result is declared once, as ``name`` (as is), ``name:i`` (whole number), ``name:d``
(date as text) or ``name:<digits>`` (rounded), and finished the same way in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.queries.fixtures import with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple((c + ":").split(":")[:2]) for c in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _parts(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        elif kind:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)  # no negative zero
        out.append(c.alias(name))
    return df.select(*out)


def select_sql(spec: str) -> str:
    out = []
    for name, kind in _parts(spec):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "d":
            c = f"CAST(CAST({c} AS DATE) AS VARCHAR)"
        elif kind:
            c = f"round(CAST({c} AS DOUBLE), {kind}) + 0.0"
        out.append(f'{c} AS "{name}"')
    return ", ".join(out)


def query(name: str, spec: str, *sql: str):
    """Register a query; ``sql`` is the derivations it uses followed by the body of the check."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: finish(fn(spark, sf), spec)
        if sql:
            *ctes, body = sql
            ORACLES[name] = f"{with_(*ctes) if ctes else ''}SELECT {select_sql(spec)} FROM ({body}) AS _r"
        return fn

    return register
