"""Running totals and ranks that do not put a whole group into one task.

A window partitioned by a key runs each key in a single task, so a key that owns a third of the
rows is the whole job. Here a group is cut into ordered chunks: every row whose hash is 0 modulo
``rows_per_chunk`` marks a cut, so small groups stay whole and a large one is split into chunks
of about that many rows. The cuts depend on the data only, not on partitioning, so a recomputed
task finds the same ones. Chunk totals are summed map-side, their running total (a few rows per
group) gives each chunk its offset, and the window inside a chunk does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.hashing import stable_hash
from ..session import stored

ROWS_PER_CHUNK = 1_000_000
SALTS = 64
ROWS_PER_PIECE = 250_000


def cuts_at_or_below(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are <= value, by halving the array."""
    n = F.size(cuts)
    steps = F.ceil(F.log2(n + 1)).cast("int")

    def halve(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), hi.alias("hi"))
        left = F.struct(lo.alias("lo"), mid.alias("hi"))
        return F.when(lo >= hi, acc).when(F.get(cuts, mid) <= value, right).otherwise(left)

    found = F.aggregate(
        F.sequence(F.lit(1), steps + 1),
        F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        halve,
        lambda acc: acc["lo"],
    )
    return F.when(cuts.isNull() | (n == 0), F.lit(0)).otherwise(found)


def with_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    cut_source: DataFrame | None = None,
) -> DataFrame:
    """Add ``_chunk``: the number of cuts of the row's group at or before it in ``order``.

    ``cut_source`` may be a cheaper frame with the same keys and order columns (for example
    the rows before deduplication): any cuts give right results. A group has few cuts (one row in
    ``rows_per_chunk``), so they are repeated for every salt and its rows are joined by group and salt:
    a group's rows never meet in one task, whatever its size.
    """
    place = F.struct(*order)
    source = (df if cut_source is None else cut_source).select(*keys, place.alias("_place"))
    marks = source.filter(F.pmod(F.xxhash64(*keys, "_place"), F.lit(rows_per_chunk)) == 0)
    cuts = marks.groupBy(*keys).agg(F.sort_array(F.collect_set("_place")).alias("_cuts"))
    if keys:
        spread = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(place), F.lit(SALTS)).cast("int"))
        placed = salted.join(spread, [*keys, "_salt"], "left").drop("_salt")
    else:
        placed = df.withColumn("_cuts", cuts.scalar())
    return placed.withColumn("_chunk", cuts_at_or_below(F.col("_cuts"), place)).drop("_cuts")


def chunk_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    coarse: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    cut_source: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows with their chunk, and per chunk the total ``_t_<name>`` of each expression.

    ``coarse`` are leading order columns with few values per group, such as a day; they cut the
    group further at no cost. ``keys`` and ``coarse`` must not be NULL.
    """
    group = [*keys, *coarse]
    chunked = with_chunks(df, group, order, rows_per_chunk, cut_source)
    totals = chunked.groupBy(*group, "_chunk").agg(
        *[F.coalesce(F.sum(expr), F.lit(0)).alias(f"_t_{name}") for name, expr in sums.items()]
    )
    return chunked, totals


def chunk_windows(keys: Sequence[str], coarse: Sequence[str] = ()) -> tuple[WindowSpec, WindowSpec]:
    """Windows over chunk totals: the whole group, and the chunks before this one."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy(*coarse, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return whole, before


def add_running(
    chunked: DataFrame,
    offsets: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, tuple[Column, str]],
    coarse: Sequence[str] = (),
) -> DataFrame:
    """Join each chunk's offset to its rows and add the running sum inside the chunk.

    ``running`` maps an output name to ``(expression, offset column)``. The join and the window
    share one shuffle on the chunk.
    """
    group = [*keys, *coarse, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(offsets, group, "inner")
    columns = {
        name: F.col(offset) + F.coalesce(F.sum(expr).over(inside), F.lit(0))
        for name, (expr, offset) in running.items()
    }
    return joined.withColumns(columns).drop("_chunk", *[offset for _, offset in running.values()])


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    coarse: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    cut_source: DataFrame | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running total of each expression within ``keys`` in ascending ``(*coarse, *order)``.

    The total includes the row itself. ``totals`` maps an output name to one of ``sums`` whose
    whole-group total is wanted too.
    """
    chunked, per_chunk = chunk_totals(df, keys, order, sums, coarse, rows_per_chunk, cut_source)
    whole, before = chunk_windows(keys, coarse)
    offsets = per_chunk.select(
        *keys,
        *coarse,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{src}").over(whole).alias(out) for out, src in (totals or {}).items()],
    )
    running = {name: (expr, f"_o_{name}") for name, expr in sums.items()}
    return add_running(chunked, offsets, keys, order, running, coarse)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    size_name: str | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """1-based rank within ``keys`` in ascending ``order`` (which should be unique in a group)."""
    return prefix_sums(
        df,
        keys,
        order,
        {name: F.lit(1).cast("long")},
        rows_per_chunk=rows_per_chunk,
        totals={size_name: name} if size_name else None,
    )


def shuffle_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_cols: Sequence[str],
    seed: int | Column,
    name: str = "rank",
    size_name: str | None = None,
) -> DataFrame:
    """1-based rank within ``keys`` in a seeded random order that any cluster reproduces.

    The order is that of a hash text, whose leading digits cut every group into even pieces of about
    ``ROWS_PER_PIECE`` rows or less, so no cut points are needed. All columns of ``df`` are moved, so pass ids
    and join the rank to wide rows afterwards. ``df`` is read once: with its hashes it is written to the shared folder,
    and counts, pieces and ranks are made from there.
    """
    placed = stored(df.withColumn("_hash", stable_hash(*[F.col(c) for c in id_cols], seed)), "hashed")
    share = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / 2.0**32
    pieces = max(1, -(-placed.count() // ROWS_PER_PIECE))
    placed = placed.withColumn("_part", F.floor(share * F.lit(float(pieces))))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(across).alias(size_name or "_size"),
    )
    joined = placed.join(offsets, [*keys, "_part"], "inner")
    inside = Window.partitionBy(*keys, "_part").orderBy("_hash", *id_cols)
    ranked = joined.withColumn(name, F.col("_offset") + F.row_number().over(inside))
    drop = ["_hash", "_part", "_offset"] + ([] if size_name else ["_size"])
    return ranked.drop(*drop)
