"""Writers: consolidated tables, flags, vocabularies, examples, splits and metrics."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def write_by_bank(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("bank").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fully quoted CSV with header."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True)


def write_flags(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write flags only when there are any; says whether it wrote.

    They are computed once, into the shared folder, and copied from there.
    """
    held = scratch_path(df.sparkSession, "flags")
    df.write.parquet(held)
    rows = df.sparkSession.read.schema(df.schema).parquet(held)
    if rows.isEmpty():
        return False
    if fmt == "csv":
        write_csv(rows, path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)
    return True


def write_examples(spark: SparkSession, df: DataFrame, path: str, metadata: Mapping[str, object]) -> None:
    """Nested examples as Parquet, and the run's arguments as one JSON row beside them."""
    df.write.mode("overwrite").parquet(path)
    text = json.dumps(dict(metadata), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}_metadata")


def write_if_absent(df: DataFrame, path: str) -> None:
    """Leave an existing output alone, so that a run can be resumed stage by stage."""
    df.write.mode("ignore").parquet(path)


def save_table(df: DataFrame, path: str) -> None:
    """Vocabulary, split or any other table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    """Metric rows are few (one per run and method), so one CSV file."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def read_flag_directories(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<root>/flag=<name>`` directory as one frame with a ``flag`` column."""
    return spark.read.option("basePath", root).parquet(f"{root}/flag=*")


def load_flags_for_evaluation(flags: DataFrame) -> DataFrame:
    """Add ``global_id`` (bank and account) and parse ``emerging_date``."""
    return flags.withColumns(
        {
            "global_id": F.concat_ws("_", "bank", F.col("accountId").cast("string")),
            "emerging_date": F.to_date("emerging_date"),
        }
    )
