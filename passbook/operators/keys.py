"""Small helpers on key columns shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    """Raise with the list of columns that are not there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def column_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Required columns that a run could not use: ``table, column, state, n_rows, n_filled``.

    ``tables`` maps a name to a frame and the columns it has to have. A column is ``absent``, or ``empty`` where it holds
    nothing but nulls; the rest is not reported. A table is read once, and only the columns in question.
    """
    parts = []
    for name, (df, columns) in tables.items():
        there = [c for c in dict.fromkeys(columns) if c in df.columns]
        filled = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(there)])
        entries = [
            F.struct(
                F.lit(c).alias("column"), F.lit("empty" if c in there else "absent").alias("state"),
                (F.col(f"_{there.index(c)}") if c in there else F.lit(0).cast("long")).alias("n_filled"),
            )
            for c in dict.fromkeys(columns)
        ]
        parts.append(filled.select(F.lit(name).alias("table"), F.col("_n").alias("n_rows"), F.inline(F.array(*entries))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter((F.col("state") == "absent") | (F.col("n_filled") == 0)).select("table", "column", "state", "n_rows", "n_filled")


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a map task sends
    at most one row per key and a group holding a large share of the copies costs no more than
    any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def tie_break(df: DataFrame, first: Sequence[Column], skip: Sequence[str] = ()) -> list[Column]:
    """``first`` followed by every remaining column, so that the order is total."""
    rest = [c for c in df.columns if c not in skip]
    return [*first, *[F.col(c).asc_nulls_last() for c in rest]]
