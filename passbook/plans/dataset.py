"""From raw transactions to nested examples: vocabulary, balances, censoring, packing."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.balance import daily_balances, feature_vector, rolling_features
from ..operators.clean import account_alias, before_cutoff, censor_subcategory, patch_schema
from ..operators.examples import build_examples
from ..operators.vocab import build_vocab
from ..session import ensure_checkpoint_dir
from ..sources.manifest import Manifest, fingerprint, fingerprints, replace_partitions
from ..sources.sinks import read_flag_directories


def build_dataset(
    txns: DataFrame,
    accounts: DataFrame | None = None,
    vocab: DataFrame | None = None,
    variant: str = "arrival",
    max_days: int = 180,
    max_txns: int = 20,
    min_days: int = 9,
    cutoff: str | None = None,
    censor_subcat: str | None = None,
    balance_source: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(examples, vocabulary)``.

    Balances come from ``balance_source`` (the uncensored history) when given. They are log
    scaled in the arrival layout and raw in the magnitude layout. A vocabulary built here is
    written to the shared folder once, because every encoded column reads it.
    """
    rows = before_cutoff(patch_schema(txns), cutoff)
    if vocab is None:
        ensure_checkpoint_dir(txns.sparkSession)
        vocab = build_vocab(rows).checkpoint()
    balance = None
    if accounts is not None:
        base = patch_schema(balance_source) if balance_source is not None else rows
        known = account_alias(accounts)
        if known is None:
            warnings.warn("the account table has no usable id column; examples are built without balances", stacklevel=2)
        else:
            balance = feature_vector(rolling_features(daily_balances(base, known)), log=variant == "arrival")
    if censor_subcat:
        rows = censor_subcategory(rows, censor_subcat)
    return build_examples(rows, vocab, balance, variant, max_days, max_txns, min_days), vocab


def build_flag_examples(
    flags_root: str,
    out: str,
    accounts: DataFrame | None,
    vocab: DataFrame,
    variant: str = "arrival",
    max_days: int = 180,
    max_txns: int = 20,
    min_days: int = 9,
) -> list[str]:
    """Examples of every ``<flags_root>/flag=<name>`` directory, written as ``<out>/flag=<name>`` by one job.

    Flags that the manifest of ``out`` has as finished from the same rows, accounts, vocabulary and settings are left as
    they are, so a run can be resumed; the flags built are returned. What a run that was stopped has left of a flag is replaced,
    and a flag none of whose accounts has ``min_days`` days is finished too. An account that several flags have is
    built once for each.
    """
    spark = vocab.sparkSession
    rows = read_flag_directories(spark, flags_root).withColumn("flag", F.col("flag").cast("string"))
    settings = [variant, max_days, max_txns, min_days, fingerprint(vocab), None if accounts is None else fingerprint(accounts)]
    manifest, prints = Manifest(spark, out), fingerprints(rows, "flag", settings)
    open_flags = manifest.open_names(prints)
    if not open_flags:
        return []
    # an account is told apart by the flag's place in the list, a number, so any text may be in flags and ids
    numbers = F.create_map(*[F.lit(x) for i, f in enumerate(open_flags) for x in (f, str(i))])
    both = lambda df: df.withColumn("accountId", F.concat_ws("|", numbers[F.col("flag")], "accountId"))
    rows = rows.filter(F.col("flag").isin(*open_flags))
    known = None if accounts is None else account_alias(accounts)
    if known is not None:
        known = known.withColumn("accountId", F.col("accountId").cast("string"))
        pairs = rows.select("flag", F.col("accountId").cast("string").alias("accountId")).distinct()
        known = both(known.join(pairs, "accountId")).drop("flag")
    built = build_dataset(both(rows).drop("flag"), known, vocab, variant, max_days, max_txns, min_days)[0]
    parts = F.split("account_id", r"\|", 2)
    flags = F.array(*[F.lit(f) for f in open_flags])
    built = built.withColumns({"flag": F.get(flags, parts[0].cast("int")), "account_id": parts[1]})
    replace_partitions(built, out, "flag", open_flags)
    manifest.finish({f: prints[f] for f in open_flags})
    return open_flags
