"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.session import scratch_path

#: A group with more than one row in this many is hot; there are at most this many such groups.
HOT_GROUPS = 1000


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    What is read later no longer depends on any executor that wrote it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_more(df: DataFrame, name: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` as ``saved`` gives it, and all that was written under ``paths`` so far, as one table. Its path joins ``paths``."""
    paths.append(scratch_path(df.sparkSession, name))
    df.write.option("compression", "zstd").parquet(paths[-1])
    read = df.sparkSession.read.schema(df.schema)
    return read.parquet(paths[-1]), read.parquet(*paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that number each row, the same whenever it is read, and their names: the place in
    its file, or, where ``docs`` is not read from files, in a copy written for this."""
    names = [fresh(docs, "_file"), fresh(docs, "_index")]
    try:
        return docs.withColumns(dict(zip(names, (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))))), names
    except AnalysisException:
        place = (F.lit(0).cast("bigint"), F.monotonically_increasing_id())
        return saved(docs.withColumns(dict(zip(names, place))), "numbered"), names


def binary_text(column: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join (``inner`` or ``left``) of ``rows`` with one row per group, safe for groups that hold much of the table.

    Groups with more than ``total / HOT_GROUPS`` rows are at most ``HOT_GROUPS`` many, so they are
    broadcast and their rows stay where they are; the other groups are joined by a shuffle in which
    none of them is large.
    """
    hot = groups.where(F.col(size) * HOT_GROUPS > total)
    cold = groups.where(F.col(size) * HOT_GROUPS <= total)
    spread = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return spread.unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
