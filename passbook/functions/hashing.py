"""Reproducible randomness: a value depends on the row's key and a seed, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts: Column | str | int) -> Column:
    """Hex digest of the parts joined by ``|``; its text order is a uniform shuffle."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that is fixed by the parts."""
    head = F.substring(stable_hash(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
