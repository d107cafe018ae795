"""Registry of workload queries: a Spark function, an output shape and, where possible, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _spec(shape: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in shape.split()]


def _spark_col(name: str, kind: str):
    col = F.col(name)
    if kind == "s":
        return col.cast("string").alias(name)
    if kind == "i":
        return col.cast("long").alias(name)
    return (F.round(col.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    ref = f'"{name}"'
    if kind == "s":
        return f"CAST({ref} AS VARCHAR) AS {ref}"
    if kind == "i":
        return f"CAST({ref} AS BIGINT) AS {ref}"
    return f"round(CAST({ref} AS DOUBLE), {int(kind[1:])}) + CAST(0 AS DOUBLE) AS {ref}"


def query(name: str, shape: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query.

    ``shape`` lists ``column:kind`` with kinds ``s`` text, ``i`` whole number and ``fN`` number
    rounded to N places. Both the Spark result and the SQL are projected to it.
    """
    spec = _spec(shape)

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in spec])

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip().rstrip(";")
            cols = ", ".join(_sql_col(n, k) for n, k in spec)
            ORACLES[name] = f"SELECT {cols} FROM (\n{body}\n) AS answer"
        return fn

    return register
