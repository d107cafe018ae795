"""Which outputs are finished, and from which input they were made.

An entry is written after the data it speaks of, so output without an entry is half-written, and output whose entry has
another fingerprint is out of date. Output that has no rows has an entry all the same.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settings_print(settings: object) -> str:
    return json.dumps(settings, sort_keys=True, default=str)


def content_columns(df: DataFrame) -> list[Column]:
    """Aggregates that tell two tables apart: how many rows, and the sum of their hashes, in whatever order they come."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    return [F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("hashes")]


def fingerprint(df: DataFrame, settings: object = None) -> str:
    """Text that changes with the rows, their columns or the settings."""
    got = df.agg(*content_columns(df)).first()
    return settings_print([df.schema.simpleString(), got.rows, got.hashes, settings])


def fingerprints(df: DataFrame, key: str, settings: object = None) -> dict[str, str]:
    """The fingerprint of every value of ``key``, which has few."""
    rest = df.drop(key)
    got = df.groupBy(F.col(key).cast("string").alias("_key")).agg(*content_columns(rest)).collect()
    return {r["_key"]: settings_print([rest.schema.simpleString(), r.rows, r.hashes, settings]) for r in got}


class Manifest:
    """The entries of one output, beside it in ``<path>_finished``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, f"{path.rstrip('/')}_finished"

    def _place(self, name: str) -> str:
        return f"{self.root}/{hashlib.md5(name.encode()).hexdigest()}"

    def entries(self) -> dict[str, str]:
        """Fingerprint by name. Entries that are being written are not there yet."""
        try:
            rows = self.spark.read.schema("name string, print string").json(f"{self.root}/*")
        except AnalysisException:
            return {}
        return {r.name: r["print"] for r in rows.collect() if r.name is not None}

    def finish(self, prints: Mapping[str, str]) -> None:
        for name, value in prints.items():
            one = self.spark.createDataFrame([(name, value)], "name string, print string")
            one.coalesce(1).write.mode("overwrite").json(self._place(name))

    def open_names(self, prints: Mapping[str, str]) -> list[str]:
        """The names whose output is missing, half-written or out of date."""
        done = self.entries()
        return sorted(n for n, p in prints.items() if done.get(n) != p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can see it; it need not be there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run_stage(
    sources: Sequence[DataFrame], path: str, build: Callable[[], DataFrame], settings: object = None, by: Sequence[str] = ()
) -> bool:
    """Write what ``build`` returns to ``path``, unless this was finished from the same ``sources`` and settings. Says
    whether it wrote."""
    manifest = Manifest(sources[0].sparkSession, path)
    prints = {"all": settings_print([[fingerprint(df) for df in sources], settings])}
    if not manifest.open_names(prints):
        return False
    build().write.mode("overwrite").partitionBy(*by).parquet(path)
    manifest.finish(prints)
    return True


def replace_partitions(df: DataFrame, path: str, key: str, names: Sequence[str]) -> None:
    """Write the rows of the named partitions of ``path`` anew; what lay there goes, also where no row follows."""
    spark = df.sparkSession
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1).alias("folder")
    try:
        held = spark.read.parquet(path).filter(F.col(key).cast("string").isin(*names)).select(folder).distinct().collect()
    except AnalysisException:
        held = []
    for r in held:
        remove(spark, unquote(r.folder))
    df.write.mode("append").partitionBy(key).parquet(path)
