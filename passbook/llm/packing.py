"""Vector best-fit packing of documents into training sequences.

A piece of ``n`` tokens takes ``n`` of a sequence's tokens, one of its documents and ``n * n`` of its attention
cost. All three follow from ``n``, so pieces of one length are alike, and the sequence chosen for them depends on
the histogram of lengths only, which has at most ``tokens`` entries however many documents there are. Sequences with
equal residual capacities are alike as well. So the plan (lengths decreasing; the best open sequences by weighted
residual norm or dot-product, under every constraint) is made for ranges of alike pieces and ranges of
alike sequences. Pieces then get their rank among those of their length by a distributed count and look up their
place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices
from .encoding import default_ranks, encode_bytes

#: Rows that are ranked in one task.
CHUNK_ROWS = 20_000


@dataclass(frozen=True)
class Limits:
    """What one sequence holds, and the weights of the three residuals when sequences are compared."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def __post_init__(self):
        if min(self.tokens, self.documents) < 1 or self.cost < self.tokens**2:
            raise ValueError("a sequence must hold one full piece")
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule!r}")


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Rows ``length, first rank, pieces, first sequence, offset``: one row places that many pieces of one length, in
    consecutive sequences at one offset. Every piece of the histogram is placed once."""
    cap = np.array([limits.tokens, limits.documents, limits.cost], float)
    weight = np.array(limits.weights)
    free = np.zeros((0, 3))  # residual capacities of each range of alike sequences
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need, rank, left = np.array([length, 1, length * length], float), 0, histogram[length]
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if not len(fits):
                each = int((cap // need).min())
                new = -(-left // each)
                free, first, many = np.vstack([free, cap]), np.append(first, opened), np.append(many, new)
                opened += new
                continue
            if limits.rule == "norm":
                score = -(((free[fits] - need) / cap) ** 2 @ weight)
            else:
                # the dot-product of what is needed and what is free, per unit of what is free
                score = (need / cap * free[fits] / cap) @ weight / np.sqrt(((free[fits] / cap) ** 2) @ weight)
            at = fits[np.argmax(score)]
            n = min(left, int(many[at]))
            places.append((length, rank, n, first[at], limits.tokens - int(free[at, 0])))
            rank, left = rank + n, left - n
            if n < many[at]:
                free, first, many = np.vstack([free, free[at]]), np.append(first, first[at] + n), np.append(many, many[at] - n)
                many[at] = n
            free[at] -= need
        open_ = (free[:, 0] > 0) & (free[:, 1] > 0) & (free[:, 2] > 0)
        free, first, many = free[open_], first[open_], many[open_]
    return np.array(places, np.int64).reshape(-1, 5)


def pieces(
    docs: DataFrame, tokens: int = 1024, end_id: int = 2, ranks_path: str | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, ids``: every document as token ids plus ``end_id``, cut where longer
    than ``tokens``. The first piece takes what is over, so all others are full. ``ids`` are little-endian unsigned
    32-bit numbers; leave the column out and it is not carried."""
    path = ranks_path or default_ranks()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            rows, numbers, starts, sizes, sums, bodies = [], [], [], [], [], []
            for row, value in enumerate(batch.column("_text").to_pylist()):
                ids = memoryview(encode_bytes(value, path) + end)
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % tokens + 1, n + 1, tokens)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    sizes.append(b - a)
                    body = ids[4 * a : 4 * b]
                    sums.append(zlib.crc32(body))
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([bytes(b) for b in bodies], pa.binary()),
                ],
                [key, "piece", "start", "length", "ids_crc32", "ids"],
            )

    read = docs.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    return read.mapInArrow(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def place(items: DataFrame, order: list[str], limits: Limits = Limits()) -> DataFrame:
    """``items`` (with a ``length``) plus ``sequence_id`` and ``offset``. ``order`` names columns that tell items apart;
    items alike in all of them may swap places. ``items`` is read twice, so pass a written table."""
    spark = items.sparkSession
    rows = items.count()
    chunks = rows // CHUNK_ROWS + 1
    cut = items.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = saved(cut.groupBy("_chunk", "length").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = plan(histogram, limits)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_chunk", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_chunk", "length").orderBy(*order)
    ranked = cut.withColumn("_within", F.row_number().over(within) - 1).join(base, ["_chunk", "length"])
    ranked = ranked.withColumn("_rank", F.col("_within") + F.col("_base")).drop("_chunk", "_within", "_base")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        starts = slots[:, 0] << 40 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            slot = slots[np.searchsorted(starts, length << 40 | rank, "right") - 1]
            names = [n for n in batch.schema.names if n != "_rank"]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    limits: Limits = Limits(),
    end_id: int = 2,
    ranks_path: str | None = None,
    text: str = "text",
    key: str = "doc_id",
    keep_ids: bool = False,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for) of every piece.

    Null and empty texts are one piece with the end id alone. A null or repeated key is kept as it is; each of its
    rows is a document. Very long texts become many full pieces. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    cut = pieces(docs, limits.tokens, end_id, ranks_path, text, key)
    cut = saved(cut if keep_ids else cut.drop("ids"), "pieces")
    out = place(cut, [key, "piece", "start", "length", "ids_crc32"], limits)
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return out.select(*columns)
