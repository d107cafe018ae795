"""Lines that many documents share, dropped from all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, join_groups, numbered, saved, slices

#: ASCII white space, stripped from both ends of a line's key.
BLANKS = b" \t\n\v\f\r"


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """The places of every distinct line key of at least ``min_chars`` code points, by the key's 128-bit hash."""
    places: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANKS).lower()  # on bytes: A-Z only
        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars):
            places.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return places


def _hashed(rows: DataFrame, names: list[str], text: str, min_chars: int) -> DataFrame:
    """``names, line, places``: one row for each document and distinct line in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "_text"):
                row, hashes, places = [], [], []
                for i, value in enumerate(part.column("_text").to_pylist()):
                    found = line_keys(value, min_chars)
                    row.extend([i] * len(found))
                    hashes.extend(found)
                    places.extend(found.values())
                take = pa.array(row, pa.int64())
                columns = [part.column(n).take(take) for n in names]
                columns += [pa.array(hashes, pa.binary()), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "line", "places"])

    shape = ", ".join(f"`{n}` bigint" for n in names)
    return rows.select(*names, binary_text(text).alias("_text")).mapInArrow(run, f"{shape}, line binary, places array<int>")


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, n_lines, n_dropped, kept_text``: one row per row of ``docs``.

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. Keys of at least ``min_chars``
    code points that at least ``min_docs`` rows hold lose all their lines in every row; the other lines stay as they
    are, in their order, joined by line feeds. A key's rows are counted after each row has named it once, so lines
    repeated inside a row count once. Only hashes of 128 bits travel; each text is moved once, to be put together
    again. A key that much of the table holds is one broadcast row, its lines stay where they are.

    Null texts count as empty, and an empty text is one empty line. Keys may be null or repeated: every row counts by
    itself. A very long text is read in one piece by one task, which holds its distinct lines. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    rows, names = numbered(docs)
    keyed = saved(_hashed(rows, names, text, min_chars), "lines")
    common = saved(keyed.groupBy("line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs), "common")
    hits = join_groups(keyed, common, ["line"], "_n", max(keyed.count(), 1))
    gone = hits.groupBy(*names).agg(F.flatten(F.collect_list("places")).alias("_gone"))
    read = rows.select(*names, F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.split("_text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    both = read.join(gone, names, "left").withColumn("_lines", lines)
    return both.select(
        F.col("_key").alias(key),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
    )
