"""Exact duplicates by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved

#: ASCII white space, which does not count when texts are compared.
SPACES = "[ \\t-\\r]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def exact_duplicates(
    docs: DataFrame, prefix: int = 256, all_digests: bool = False, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, keep_id, group_size, kept, twins, text_sha256``: one row per row of ``docs``.

    Texts are equal when identical without ASCII white space. Rows are grouped by normalised length, then, in
    lengths that occur more than once, by a hash of the first ``prefix`` characters, and only in what is left
    by SHA-256 of the whole text. ``text_sha256`` is null for rows that an earlier step has set apart, unless
    ``all_digests`` asks for every row's digest; then it is taken in the first read and there is no second one.

    The row with the most code points in the original text stays, then the one with the smallest key (null
    keys last). Rows that are alike in text and key both count as the row that stays: ``kept`` is true for
    each and ``twins`` says how many there are (1 as a rule). Null texts count as empty. A very
    long text is read by its task as any other and never moved. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    read = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), normalised(text).alias("_norm"))
    first = [
        F.length("_text").alias("_chars"),
        F.length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix"),
    ]
    full = F.sha2(F.encode("_norm", "UTF-8"), 256)
    rows = saved(
        read.select("_key", *first, (full if all_digests else F.lit(None).cast("string")).alias("_sha")), "signatures"
    )
    total = max(rows.count(), 1)
    lengths = rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1")
    alike = join_groups(rows, lengths, ["_len"], "_n", total).drop("_n")
    prefixes = alike.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    prefixes = saved(prefixes, "prefixes")
    begin, same = ["_len", "_prefix"], ["_len", "_prefix", "_sha"]
    if all_digests:
        left = join_groups(rows, prefixes, begin, "_n", total).drop("_n")
    else:
        again = read.select("_key", *first, full.alias("_sha"))
        left = saved(join_groups(again, prefixes, begin, "_n", total).drop("_n"), "survivors")
    alike = left.groupBy(*same, "_chars", "_key").agg(F.count("*").alias("_rows"))
    best = F.min(F.struct(-F.col("_chars"), F.col("_key").isNull(), "_key", "_rows")).alias("_best")
    groups = alike.groupBy(*same).agg(best, F.sum("_rows").alias("_size")).where("_size > 1")
    groups = saved(
        groups.select(
            *same, "_size", F.col("_best.col1").alias("_longest"), F.col("_best._key").alias("_keep"), F.col("_best._rows").alias("_twins")
        ),
        "groups",
    )
    if all_digests:
        out = join_groups(rows, groups, same, "_size", total, "left")
    else:
        alone = join_groups(rows, prefixes, begin, "_n", total, "left").where("_n IS NULL").drop("_n")
        out = join_groups(left, groups, same, "_size", total, "left")
        out = out.unionByName(alone, allowMissingColumns=True)
    single = F.col("_size").isNull()
    return out.select(
        F.col("_key").alias(key),
        F.when(single, F.col("_key")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).alias("group_size"),
        (single | (F.col("_key").eqNullSafe(F.col("_keep")) & (F.col("_chars") == -F.col("_longest")))).alias("kept"),
        F.coalesce("_twins", F.lit(1)).alias("twins"),
        F.col("_sha").alias("text_sha256"),
    )
