"""Token vocabularies: stable ids, encoding and decoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .clean import ALIASES, find_column
from .ordered import ROWS_PER_CHUNK, rank_rows

# Reserved ids and tokens.
PAD_ID, UNK_ID, FIRST_ID = 0, 1, 2
PAD, UNK = "<PAD>", "<UNK>"

FEATURES = {"cat_group": "categoryGroupId", "cat_sub": "subCategoryId", "cat_cp": "counterParty"}


def feature_columns(df: DataFrame, features: Mapping[str, str] = FEATURES) -> dict[str, str | None]:
    """Which column of the frame feeds each feature."""
    return {f: find_column(df, ALIASES[name]) for f, name in features.items()}


def distinct_tokens(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct non-missing tokens per feature, as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"`{c}`").cast("string").alias("token"))
            for f, c in columns.items()
        ]
    )
    tokens = df.select(F.inline(pairs)).distinct()
    return tokens.filter(
        F.col("token").isNotNull() & (F.col("token") != "") & ~F.col("token").isin(PAD, UNK, "NaN", "nan")
    )


def build_vocab(df: DataFrame, columns: Mapping[str, str] | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``(feature, token, token_id)`` with ids from 2 in the byte order of the tokens.

    ``df`` is read once: its distinct tokens are written to the shared folder and ranked from there.
    """
    if columns is None:
        columns = {f: c for f, c in feature_columns(df).items() if c}
    tokens = stored(distinct_tokens(df, columns), "tokens")
    ranked = rank_rows(tokens, ["feature"], ["token"], "token_id", rows_per_chunk=rows_per_chunk)
    return ranked.select("feature", "token", (F.col("token_id") + (FIRST_ID - 1)).cast("int").alias("token_id"))


def encoded(raw: Column, token_id: Column) -> Column:
    """Joined id to final id: missing token -> PAD, token not in the vocabulary -> UNK."""
    raw = raw.cast("string")
    missing = raw.isNull() | (raw == "")
    return F.when(missing, F.lit(PAD_ID)).otherwise(F.coalesce(token_id, F.lit(UNK_ID)))


def encode(df: DataFrame, vocab: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``<feature>`` with the id of the token in the mapped column.

    The vocabulary side has unique keys; Spark broadcasts it only below its size threshold, and
    past that the adaptive skew join splits hot tokens.
    """
    out = df
    for feature, column in columns.items():
        side = vocab.filter(F.col("feature") == feature).select(
            F.col("token").alias(f"_tok_{feature}"), F.col("token_id").alias(f"_id_{feature}")
        )
        out = out.join(side, F.col(f"`{column}`").cast("string") == F.col(f"_tok_{feature}"), "left")
        out = out.withColumn(feature, encoded(F.col(f"`{column}`"), F.col(f"_id_{feature}"))).drop(
            f"_tok_{feature}", f"_id_{feature}"
        )
    return out


def decode(df: DataFrame, vocab: DataFrame, feature: str, id_column: str, out: str = "token") -> DataFrame:
    """Add the token of an id: ``<PAD>`` for 0, ``<UNK>`` for 1 and for ids that do not exist."""
    side = vocab.filter(F.col("feature") == feature).select(
        F.col("token").alias("_tok"), F.col("token_id").alias("_tid")
    )
    joined = df.join(side, F.col(id_column) == F.col("_tid"), "left")
    token = F.when(F.col(id_column) == PAD_ID, PAD).otherwise(F.coalesce(F.col("_tok"), F.lit(UNK)))
    return joined.withColumn(out, token).drop("_tok", "_tid")


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    """Tokens per feature, the two reserved ones included."""
    return vocab.groupBy("feature").agg((F.count(F.lit(1)) + FIRST_ID).alias("n_tokens"))
