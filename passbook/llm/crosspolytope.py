"""Nearest neighbours by inner product with cross-polytope hashing.

A vector is turned by pseudo-rotations, each three rounds of random signs and a fast Hadamard transform, and its
bucket is the signed axis that it then lies nearest to. Every row is in one bucket of each table; a query looks into
the buckets of its nearest ``probes`` axes in each table. Candidates are compared exactly, in double precision.

Inner products of vectors of unequal length are not angles. Then every vector gets one coordinate more, which
brings all to the greatest length, and queries get a zero there: the angles then order as the inner products do.

Equal vectors are one entry of the index, so copies neither fill a bucket nor pair up. A bucket that holds many
entries is cut into blocks; blocks of entries meet blocks of queries, and each such meeting is one
matrix product with its best results kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, saved

BLOCK = 2048
#: Products of blocks are sums in another order than the exact ones: how far they may be apart, and to how many digits
#: they are compared.
NEAR, DIGITS = 1e-9, 9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def nearest_axes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Rows x tables x probes: the signed axes nearest to each rotated row, nearest first, as 2 * axis + sign."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.empty((n, tables, min(probes, size)), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], size))
        order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = order * 2 + (np.take_along_axis(y, order, 1) > 0)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _hashed(vectors: DataFrame, tables: int, probes: int, seed: int, longest: float | None, query: bool) -> DataFrame:
    """``table, bucket, rep, embedding``: one row per table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                x = _matrix(part.column("embedding"))
                if longest is not None:
                    squares = (x * x).sum(axis=1)
                    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - squares, 0))
                    x = np.column_stack([x, more])
                axes = nearest_axes(x, tables, probes, seed)
                row, table, probe = np.indices(axes.shape).reshape(3, -1)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(table.astype("i4")),
                        pa.array(axes.reshape(-1).astype("i4")),
                        part.column("rep").take(take),
                        part.column("embedding").take(take),
                    ],
                    ["table", "bucket", "rep", "embedding"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("rep", "embedding").mapInArrow(run, f"table int, bucket int, rep bigint, embedding {kind}")


def _meet(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """``query, rep, score``: for every query, the ``keep`` best entries of each block that it meets and all that tie
    with the last of them, so that nothing depends on the order in which blocks are filled.

    Both have ``table, bucket, rep, embedding``. Entries are cut into blocks by a hash. There are as many counts as
    tables times axes, a constant, so the counts are broadcast.
    """
    spread = index.groupBy("table", "bucket").agg(F.count("*").alias("_n"))
    blocks = spread.select("table", "bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    blocks = F.broadcast(saved(blocks, "buckets"))
    pack = F.collect_list(F.struct("rep", "embedding"))
    cut = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    left = index.join(blocks, ["table", "bucket"]).withColumn("_block", cut)
    left = left.groupBy("table", "bucket", "_block").agg(pack.alias("entries"))
    many = F.broadcast(
        saved(
            queries.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts")), "probes"
        )
    )
    right = queries.join(many, ["table", "bucket"]).withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_parts")))
    right = right.groupBy("table", "bucket", "_part").agg(pack.alias("asked")).join(blocks, ["table", "bucket"])
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # blocks hold more than the optimizer expects: never broadcast them
    both = left.hint("merge").join(right.drop("_blocks"), ["table", "bucket", "_block"]).select("entries", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries, asked = (batch.column(c).slice(i, 1).flatten() for c in ("entries", "asked"))
                ids, wanted = (a.field("rep").to_numpy() for a in (entries, asked))
                scores = _matrix(asked.field("embedding")) @ _matrix(entries.field("embedding")).T
                n = len(ids)
                cut = np.partition(scores, n - keep, axis=1)[:, n - keep] if n > keep else np.full(len(scores), -np.inf)
                query, best = np.nonzero(scores >= (cut - NEAR * np.maximum(1, np.abs(cut)))[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[query]), pa.array(ids[best]), pa.array(scores[query, best])], ["query", "rep", "score"]
                )

    return both.mapInArrow(run, "query bigint, rep bigint, score double")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each query and all that tie with the last of them, as far as products of blocks can tell:
    these are rounded, and exact products decide later."""
    place = Window.partitionBy("query").orderBy(F.desc(F.round("score", DIGITS)))
    once = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    return once.withColumn("_place", F.rank().over(place)).where(F.col("_place") <= keep).drop("_place")


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null, not zero and has finite components only."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    tables: int = 12,
    probes: int = 10,
    seed: int = 42,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` nearest of every row that the condition ``is_query`` holds for.

    Nearest first, by inner product in double precision, ties to the smaller key; the query's own row is not
    among them. A query for which the buckets hold fewer than ``k`` others is compared with every row, in blocks.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null
    key, nor vectors of another size than most have. Rows repeated with the same key are one row. Very long
    vectors make blocks of as many rows larger. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    v = F.col(vector)
    rows = usable(vectors.where(F.col(key).isNotNull()), vector)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), v.alias("embedding"), is_query.alias("asks"))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = saved(rows.where(F.size("embedding") == (size.d if size else 0)).dropDuplicates(["id"]), "vectors")
    total = rows.count()
    entries = rows.groupBy("embedding").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.max(F.col("asks").cast("int")).alias("asks")
    )
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    entries = saved(entries.withColumn("length", length), "entries")
    members = saved(
        join_groups(rows, entries.select("embedding", "rep", "n"), ["embedding"], "n", max(total, 1)).select(
            "id", "rep", "asks", "n"
        ),
        "members",
    )
    spread = entries.agg(F.min("length"), F.max("length")).first()
    longest = None if spread[0] is None or spread[1] - spread[0] <= 1e-3 * spread[1] else spread[1]
    asked = entries.where("asks = 1")
    index = _hashed(entries, tables, 1, seed, longest, False)
    found = _best(_meet(index, _hashed(asked, tables, probes, seed, longest, True), k + 1), k + 1)
    found = saved(found, "found")
    # entries found for each query, and the rows behind them
    enough = min(k, total - 1)
    rows_found = found.join(entries.select("rep", "n"), "rep").groupBy("query").agg(F.sum("n").alias("_rows"))
    short = asked.join(rows_found.withColumnRenamed("query", "rep"), "rep", "left")
    short = saved(short.where(F.coalesce("_rows", F.lit(0)) < enough + 1).select("rep", "embedding"), "short")
    if not short.isEmpty():
        one = {"table": F.lit(-1), "bucket": F.lit(0)}
        rest = _meet(entries.select("rep", "embedding").withColumns(one), short.withColumns(one), k + 1)
        found = saved(_best(found.join(short, found["query"] == short["rep"], "left_anti").union(rest), k + 1), "found")
    # a query's own copies are always candidates
    found = found.select("query", "rep").union(asked.select(F.col("rep").alias("query"), "rep")).distinct()
    first = Window.partitionBy("rep").orderBy("id")
    some = members.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k + 1).select("rep", "id")
    own, other = entries.select(F.col("rep").alias("query"), F.col("embedding").alias("_q")), entries.select("rep", "embedding")
    products = F.zip_with("_q", "embedding", lambda a, b: a.cast("double") * b.cast("double"))
    scored = found.join(own, "query").join(other, "rep")
    scored = scored.select("query", "rep", F.aggregate(products, F.lit(0.0), lambda s, x: s + x).alias("score"))
    ahead = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    expanded = scored.join(some, "rep").withColumn("_place", F.row_number().over(ahead)).where(F.col("_place") <= k + 1)
    lists = saved(
        expanded.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_place", "id", "score"))).alias("near")), "lists"
    )
    askers = members.where("asks").select(F.col("id").alias("query_id"), F.col("rep").alias("query"), "n")
    sized = lists.join(entries.select(F.col("rep").alias("query"), "n"), "query")
    answers = join_groups(askers.drop("n"), sized, ["query"], "n", max(total, 1))
    others = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    return answers.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_near")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_near.id").alias(key), F.col("_near.score").alias("score")
    )
