"""Hard negatives: rows of another label that come just below an anchor's positives.

Anchors meet all rows block by block: one matrix product of whole numbers for each pair of blocks. Of each product only
what an answer can hold goes on. A first turn finds every anchor's positives, whose scores are the tops of its windows; a
second one keeps, for every window, the first rows of another label inside it. What is kept is keyed by
(anchor, falling score, positive before negative, id), dealt by anchor and sorted inside the partitions, which is
``repartitionAndSortWithinPartitions`` in DataFrame form. A streaming iterator then walks each anchor once: a positive
opens a window, a negative is emitted for the windows it falls in. It holds the open windows only, never an anchor's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved

#: Bytes of a block of rows and of one of anchors; anchors whose products are held at a time.
ROW_BYTES, ANCHOR_BYTES, TURN = 2 << 20, 1 << 20, 128
SCALE = 256
LEAST = np.iinfo(np.int64).min


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of every component, in double precision; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number inner products of all rows, exact: in doubles where no sum can pass 2 ** 53, else in longs.
    Raises where one could pass a long."""
    top = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if top >= 2.0**62:
        raise ArithmeticError("components are too large for inner products of 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def leading(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest allowed scores of each row, ties to the smaller column."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.where(allowed, scores, LEAST)
    n = held.shape[1]
    limit = np.partition(held, n - most, axis=1)[:, n - most] if n > most else np.full(len(held), LEAST)
    row, col = np.nonzero(allowed & (held >= limit[:, None]))
    order = np.lexsort((col, -held[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], col[place < most]


def _packed(rows: DataFrame, size: int, width: int, tops: bool) -> DataFrame:
    """``block, n, row, id, label, values[, tops]``: blocks of about ``size`` rows as bytes, one row each, made of what a
    task reads in sequence. Rows are ordered by id inside a block."""
    names = ["row", "id", "label", "values", *(["tops"] if tops else [])]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.lexsort((batch.column("row").to_numpy(), batch.column("id").to_numpy()))
        x = whole_numbers(batch.column("vector"), width)[order]
        parts = [batch.column(c).to_numpy()[order].tobytes() for c in ("row", "id", "label")] + [x.tobytes()]
        if tops:
            parts.append(np.stack([np.array(t, np.int64) for t in batch.column("tops").take(pa.array(order)).to_pylist()]).tobytes())
        mark = int(batch.column("row")[0].as_py())
        columns = [pa.array([mark], pa.int64()), pa.array([batch.num_rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array([p], pa.binary()) for p in parts], ["block", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                held.append(batch.slice(i, size))
                count += held[-1].num_rows
                if count >= size:
                    yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, count = [], 0
        if count:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "block bigint, n bigint, " + ", ".join(f"{n} binary" for n in names))


def _meet(anchors: DataFrame, blocks: DataFrame, width: int, pick) -> DataFrame:
    """``anchor, anchor_id, positive, id, score``: what ``pick`` keeps of each pair of blocks.

    Every pair of an anchor block and a row block is one key of the join, so both sides are repeated for the other's
    blocks and no key holds more than one of each.
    """
    sides = [
        (anchors.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns}), "a_block", blocks, "block"),
        (blocks, "block", anchors.withColumnRenamed("block", "a_block"), "a_block"),
    ]
    spread = []
    for rows, _, others, name in sides:
        every = others.select(name).agg(F.collect_set(name).alias(f"_{name}"))  # one number a block
        spread.append(rows.withColumn(name, F.explode(every.scalar())))
    both = spread[1].hint("merge").join(spread[0], ["a_block", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                one = {c: np.frombuffer(pair[c], np.int64) for c in ("row", "id", "label", "a_row", "a_id", "a_label")}
                x = np.frombuffer(pair["values"], np.float64).reshape(-1, width)
                y = np.frombuffer(pair["a_values"], np.float64).reshape(-1, width)
                tops = np.frombuffer(pair["a_tops"], np.int64).reshape(len(y), -1) if "a_tops" in pair else None
                for i in range(0, len(y), TURN):
                    cut = slice(i, i + TURN)
                    scores = products(y[cut], x)
                    alike = one["a_label"][cut, None] == one["label"]
                    other = one["a_row"][cut, None] != one["row"]
                    for positive, row, col in pick(scores, alike, other, None if tops is None else tops[cut]):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(one["a_row"][cut][row]),
                                pa.array(one["a_id"][cut][row]),
                                pa.array(np.full(len(row), positive)),
                                pa.array(one["row"][col]),
                                pa.array(one["id"][col]),
                                pa.array(scores[row, col]),
                            ],
                            ["anchor", "anchor_id", "positive", "row", "id", "score"],
                        )

    wanted = ["row", "id", "label", "values"]
    wanted += [f"a_{c}" for c in wanted] + (["a_tops"] if "tops" in anchors.columns else [])
    return both.select(*wanted).mapInArrow(
        run, "anchor bigint, anchor_id bigint, positive boolean, row bigint, id bigint, score bigint"
    )


def _windows(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by anchor, falling score, positives first, id: positives open windows, negatives are emitted."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    anchor, opened, windows = None, 0, []
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("anchor", "anchor_id", "positive", "id", "score"))
        for at, anchor_id, positive, other, score in zip(*columns):
            if at != anchor:
                anchor, opened, windows = at, 0, []
            if positive:
                if opened < positives:
                    opened += 1
                    windows.append([other, score, 0])
                continue
            # scores fall: a window that this one lies below is over, as is a full one
            windows = [w for w in windows if high * score >= low * w[1] and w[2] < negatives]
            for w in windows:
                w[2] += 1
                out.append((anchor_id, w[0], w[2], other, w[1], score))
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def hard_negatives(
    vectors: DataFrame,
    is_anchor,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that the condition ``is_anchor`` holds for. Scores are inner products of floor(256 * x), exact.
    An anchor's positives are its first ``positives`` other rows of the same label, and for each of them the first
    ``negatives`` rows of another label with low * positive_score <= high * negative_score <= high * positive_score come
    out, ranked from 1. Higher scores come first, ties by the smaller id. So a positive below zero has no negatives.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part; zero vectors do. Of
    vectors of different sizes the shorter count as ending in zeros; a very long vector makes blocks larger, nothing else.
    Repeated rows are rows of their own: a repeated anchor returns its rows once for each. An empty table gives an empty
    result. Other columns are ignored, whatever their names. Products that could pass 64 bits raise ``ArithmeticError``.
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = vectors.where(v.isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & ~bad)
    row = fresh(read, "_row")
    rows = read.withColumn(row, F.monotonically_increasing_id()).select(
        F.col(row).alias("row"), F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        v.cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = saved(rows, "vectors")
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    row_block, anchor_block = (max(1, n // (8 * width)) for n in (ROW_BYTES, ANCHOR_BYTES))
    blocks = saved(_packed(rows.drop("asks"), row_block, width, False), "blocks")
    asked = rows.where("asks").drop("asks")
    parts = max(4, asked.count() // anchor_block)

    def same(scores, alike, other, _):
        yield (True, *leading(scores, alike & other, positives))

    place = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    found = _meet(saved(_packed(asked.repartition(parts, "row"), anchor_block, width, False), "anchors"), blocks, width, same)
    found = found.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= positives).drop("_place")
    found = saved(found, "positives")
    # a window's top, for each place; one that is not there is null, and holds nothing
    tops = found.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list("score")).alias("tops"))
    missing = F.array_repeat(F.lit(-1).cast("bigint"), F.lit(positives) - F.size("tops"))
    tops = tops.withColumn("tops", F.concat("tops", missing))
    asked = saved(_packed(asked.join(tops, "row").repartition(parts, "row"), anchor_block, width, True), "windows")

    def apart(scores, alike, other, tops):
        inside = np.zeros(scores.shape, bool)
        for top in np.sort(tops, axis=1).T:
            # a top below zero has no row inside
            least = np.array([-(-low * t // high) for t in top.tolist()], np.int64)
            fits = ~alike & (scores <= top[:, None]) & (scores >= least[:, None])
            inside[leading(scores, fits, negatives)] = True
        yield (False, *np.nonzero(inside))

    # ids order by (falling score, positive first, id) inside an anchor
    pairs = found.unionByName(_meet(asked, blocks, width, apart))
    keyed = pairs.select("anchor", (-F.col("score")).alias("fall"), (~F.col("positive")).alias("after"), "id", "row", "anchor_id", "positive", "score")
    dealt = keyed.repartition("anchor").sortWithinPartitions("anchor", "fall", "after", "id", "row")
    return dealt.select("anchor", "anchor_id", "positive", "id", "score").mapInArrow(
        lambda batches: _windows(batches, positives, negatives, low, high),
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    )
