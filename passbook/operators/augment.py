"""Views of examples for contrastive training, reproducible from ids and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .ordered import shuffle_rank

# Fixed values of the two augmentations.
MIN_DAYS = 5
CROP_LOW, CROP_HIGH = 0.6, 0.9
DROP_SHARE = 0.2


def last_days(days: Column, n: int) -> Column:
    """The last ``n`` elements, or all of them."""
    size = F.size(days)
    take = F.least(size, F.lit(n))
    return F.when(size == 0, days).otherwise(F.slice(days, size - take + 1, take))


def crop_bounds(n_days: Column, draw_size: Column, draw_start: Column, max_days: int) -> tuple[Column, Column]:
    """0-based start and length of a random contiguous window of 60-90 % of the days."""
    share = F.lit(CROP_LOW) + draw_size * (CROP_HIGH - CROP_LOW)
    length = F.least(F.greatest(F.lit(MIN_DAYS), F.floor(n_days * share).cast("int")), F.lit(max_days))
    start = F.floor(draw_start * (n_days - length + 1)).cast("int")
    return start, length


def temporal_crop(days: Column, draw_size: Column, draw_start: Column, max_days: int) -> Column:
    start, length = crop_bounds(F.size(days), draw_size, draw_start, max_days)
    return F.slice(days, start + 1, length)


def random_drop(days: Column, key: tuple[Column | str | int, ...], max_days: int) -> Column:
    """Drop each day with p = 0.2; if none is left keep the first two; cap to the last days."""
    kept = F.filter(days, lambda _, i: uniform(*key, "day", i) > DROP_SHARE)
    kept = F.when(F.size(kept) == 0, F.slice(days, 1, 2)).otherwise(kept)
    return last_days(kept, max_days)


def augment(
    examples: DataFrame, seed: int, max_days: int = 360, view: str | None = None, days: str = "days"
) -> DataFrame:
    """Crop or drop, half and half; examples under five days are unchanged."""
    key = (F.col("account_id"), *([F.col(view)] if view else []), seed)
    n = F.size(days)
    cropped = temporal_crop(F.col(days), uniform(*key, "size"), uniform(*key, "start"), max_days)
    dropped = random_drop(F.col(days), key, max_days)
    chosen = (
        F.when(n < MIN_DAYS, F.col(days)).when(uniform(*key, "kind") < 0.5, cropped).otherwise(dropped)
    )
    return examples.withColumn(days, chosen).withColumn("n_days", F.size(days))


def cap_days(examples: DataFrame, max_days: int = 360) -> DataFrame:
    """Without augmentation: just the last ``max_days``."""
    return examples.withColumn("days", last_days(F.col("days"), max_days)).withColumn("n_days", F.size("days"))


def two_views(examples: DataFrame, seed: int, max_days: int = 360) -> DataFrame:
    """Two independently augmented copies of every example, ``view`` 1 and 2."""
    copies = examples.withColumn("view", F.explode(F.array(F.lit(1), F.lit(2))))
    return augment(copies, seed, max_days, view="view")


def assign_batches(rows: DataFrame, batch_size: int, seed: int, id_col: str = "account_id") -> DataFrame:
    """Add ``batch_id``: seeded shuffle cut into batches of ``batch_size``. Ids are unique; only they are ranked."""
    ranked = shuffle_rank(rows.select(id_col), [], [id_col], seed, "_rank")
    batches = ranked.select(id_col, F.floor((F.col("_rank") - 1) / batch_size).alias("batch_id"))
    return rows.join(batches, id_col)
