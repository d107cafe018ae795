"""Embedding tables: pooling, contrastive metrics, projection and clustering quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..functions.vectors import dot, l2_normalize
from ..session import stored
from .augment import assign_batches
from .clean import dedupe_by

# Fixed values.
TEMPERATURE = 0.07
MAIN_TYPES = ("Checking", "Savings", "Credit Card", "Loan")
MIN_SAMPLES = 100
#: Rows of a block of the similarity matrix, which is one task's, and how many blocks a side has before they grow.
BLOCK, LARGEST, SIDE = 1024, 32_768, 12
#: Rows and columns of a product that is held at once.
TILE = 512
#: Products of rows, of large batches, for each of their tasks.
PRODUCTS = 1 << 24
#: Logits in a range up to this have exponentials relative to one common bound; in wider ones these could vanish.
RANGE = 600.0


def mean_pool(rows: DataFrame, keys: Sequence[str], vector: str, out: str = "pooled") -> DataFrame:
    """Element-wise mean of an array column per group, summed map-side."""
    mean = Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def pool_days(rows: DataFrame, vector: str, dim: int, keys: Sequence[str] = ("account_id", "day_offset")) -> DataFrame:
    """Mean of the transactions of each stream, credit and debit side by side, zeros when empty."""
    pooled = mean_pool(rows, [*keys, "stream"], vector)
    zeros = F.array_repeat(F.lit(0.0), dim)
    side = lambda s: F.coalesce(F.max(F.when(F.col("stream") == s, F.col("pooled"))), zeros)
    return pooled.groupBy(*keys).agg(F.concat(side("pos"), side("neg")).alias("day_vector"))


def pool_accounts(days: DataFrame, key: str = "account_id") -> DataFrame:
    """Mean of the day vectors of each account."""
    return mean_pool(days, [key], "day_vector", "account_vector")


def concat_features(df: DataFrame, embedding: str, features: str, out: str = "hybrid") -> DataFrame:
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    return df.withColumn(out, F.concat(as_double(embedding), as_double(features)))


def tail_features(df: DataFrame, features: str, n: int = 7, out: str = "tail") -> DataFrame:
    return df.withColumn(out, F.slice(features, -n, n))


def with_account_types(embeddings: DataFrame, accounts: DataFrame, id_col: str = "id") -> DataFrame:
    """Embeddings with the type of their account, NULL when the account is unknown."""
    types = dedupe_by(accounts.select(id_col, "type"), [id_col], ["type"])
    return embeddings.join(types, id_col, "left")


def known_types(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type").isNotNull())


def main_types(df: DataFrame, types: Sequence[str] = MAIN_TYPES, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Rows of the main types, or none when there are not more than ``min_samples`` of them."""
    kept = df.filter(F.col("type").isin(*types))
    enough = kept.agg((F.count(F.lit(1)) > min_samples).alias("ok")).scalar()
    return kept.filter(enough)


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` rows without replacement, the same ones on every cluster."""
    order = stable_hash(F.col(id_col), seed)
    return df.withColumn("_h", order).orderBy("_h", id_col).limit(n).drop("_h")


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=float).reshape(len(rows), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _blocks(pairs: DataFrame, batch_size: int, seed: int, id_col: str) -> tuple[DataFrame, int]:
    """The id, ``batch_id, _blocks, _block`` and the vectors, and how many rows there are: batches cut into blocks by a hash of the id.

    A batch of up to ``SIDE`` * ``BLOCK`` rows has blocks of about ``BLOCK``. A larger one has ``SIDE`` larger blocks, up to
    ``LARGEST`` rows each, and more of them beyond. A row is sent once for each block, so what is sent grows with the rows.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    vectors = [c for c in ("a", "b", "hard") if c in pairs.columns]
    dealt = stored(assign_batches(pairs.select(id_col, *vectors), batch_size, seed, id_col), "dealt")
    n = dealt.count()
    # all batches are full but the last, so no join by batch is needed, which would put a batch into one task
    size = F.least(F.lit(batch_size), F.lit(n) - F.col("batch_id") * batch_size)
    blocks = F.greatest(F.least(F.ceil(size / BLOCK), F.lit(SIDE)), F.ceil(size / LARGEST)).cast("int")
    cut = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.col("_blocks")).cast("int")
    return dealt.withColumn("_blocks", blocks).withColumn("_block", cut), n


def _shifted(logits: np.ndarray, limit: float, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit along ``axis`` (``limit``, where it is known to be no smaller) and the sum of exponentials relative to it."""
    most = logits.max(axis=axis) if np.isnan(limit) else np.full(logits.shape[1 - axis], limit)
    return most, np.exp(logits - np.expand_dims(most, axis)).sum(axis=axis)


class _States:
    """The states of one side's rows of a block pair, to which tiles of the product are added."""

    def __init__(self, n: int, top: int | None):
        self.most, self.mass = np.full(n, -np.inf), np.zeros(n)
        self.best, self.total, self.own = np.full(n, -np.inf), np.zeros(n), np.full(n, np.nan)
        self.top, self.near = top, (np.empty((n, 0)), np.empty((n, 0), dtype=int))

    def add_mass(self, at: slice, most: np.ndarray, mass: np.ndarray) -> None:
        new = np.maximum(self.most[at], most)
        self.mass[at] = self.mass[at] * np.exp(self.most[at] - new) + mass * np.exp(most - new)
        self.most[at] = new

    def add_values(self, at: slice, sims: np.ndarray, start: int) -> None:
        """Best, total and nearest of ``sims``, whose columns are the others from place ``start`` on."""
        if self.top is None:
            return
        self.best[at] = np.maximum(self.best[at], sims.max(axis=1))
        self.total[at] += sims.sum(axis=1)
        if self.top:
            values, places = self.near[0][at], self.near[1][at]
            values = np.hstack([values, sims])
            places = np.hstack([places, np.broadcast_to(np.arange(start, start + sims.shape[1]), sims.shape)])
            order = np.lexsort((places, -values), axis=1)[:, : self.top]
            self._keep(at, np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1))

    def _keep(self, at: slice, values: np.ndarray, places: np.ndarray) -> None:
        if self.near[0].shape[1] < values.shape[1]:
            more = values.shape[1] - self.near[0].shape[1]
            n = len(self.near[0])
            self.near = (np.hstack([self.near[0], np.full((n, more), -np.inf)]), np.hstack([self.near[1], np.full((n, more), -1)]))
        self.near[0][at], self.near[1][at] = values, places

    def frame(self, batch: int, side: str, id_col: str, ids: list, others: list) -> pd.DataFrame:
        near = [[] for _ in ids]
        if self.top:
            near = [
                [{"id": others[j], "s": v} for v, j in zip(values, places) if j >= 0]
                for values, places in zip(self.near[0].tolist(), self.near[1].tolist())
            ]
        return pd.DataFrame(
            {
                "batch_id": batch, "side": side, id_col: ids, "n": len(others), "most": self.most, "mass": self.mass,
                "best": self.best, "total": self.total, "own": self.own, "near": near,
            }
        )


def block_states(
    pairs: DataFrame, batch_size: int, seed: int, temperature: float = 1.0, id_col: str = "id", top: int | None = None
) -> DataFrame:
    """Per ``side`` (``a`` rows, ``b`` columns), batch and id: what one block of the batch's similarity matrix adds.

    Each pair of blocks of a batch is one key, whose product is made in tiles of ``TILE`` rows and columns; a batch may be the
    whole table. Of a product only a state for each row and column leaves the task: ``most`` (a logit no smaller than the largest),
    ``mass`` (sum of exponentials relative to it), ``own`` (the row's own pair, where it is in the block), and, where
    ``top`` is given, ``best`` and ``total`` of the similarities and the ``top`` nearest. States of one id add up to that of
    its whole row (``merged_states``).
    """
    rows, n = _blocks(pairs, batch_size, seed, id_col)
    kind, hard = dict(pairs.dtypes)[id_col], "hard" in pairs.columns
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    more = F.col("hard") if hard else F.lit(None).cast("array<double>")
    sides = [
        rows.select("batch_id", F.col("_block").alias("_i"), every.alias("_j"), id_col, F.col("a").alias("_v"), more.alias("hard"), F.lit("a").alias("_side")),
        rows.select("batch_id", every.alias("_i"), F.col("_block").alias("_j"), id_col, F.col("b").alias("_v"), more.alias("hard"), F.lit("b").alias("_side")),
    ]
    # cosines lie in -1 to 1
    limit = 1 / temperature if 2 / temperature <= RANGE else np.nan

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = (pdf[pdf["_side"] == s].sort_values(id_col) for s in "ab")
        if not len(one) or not len(other):
            return pd.DataFrame(columns=names)
        ids, others = one[id_col].tolist(), other[id_col].tolist()
        a, b = _unit(one["_v"]), _unit(other["_v"])
        left, right = _States(len(ids), top), _States(len(others), top)
        for i in range(0, len(ids), TILE):
            at = slice(i, min(i + TILE, len(ids)))
            for j in range(0, len(others), TILE):
                to = slice(j, min(j + TILE, len(others)))
                sims = a[at] @ b[to].T
                left.add_values(at, sims, j)
                if not hard:
                    right.add_values(to, sims.T, i)
                logits = sims / temperature
                if hard or np.isnan(limit):
                    left.add_mass(at, *_shifted(logits, limit, 1))
                    if not hard:
                        right.add_mass(to, *_shifted(logits, limit, 0))
                    continue
                # one exponential serves the row and the column
                shares = np.exp(np.subtract(logits, limit, out=logits), out=logits)
                left.add_mass(at, np.full(len(shares), limit), shares.sum(axis=1))
                right.add_mass(to, np.full(shares.shape[1], limit), shares.sum(axis=0))
        if key[1] == key[2]:
            left.own = right.own = np.einsum("ij,ij->i", a, b)
            if hard:
                extra = np.einsum("ij,ij->i", a, _unit(one["hard"])) / temperature
                left.add_mass(slice(0, len(ids)), extra, np.ones(len(ids)))
        found = left.frame(key[0], "a", id_col, ids, others)
        return found if hard else pd.concat([found, right.frame(key[0], "b", id_col, others, ids)])

    schema = (
        f"batch_id long, side string, {id_col} {kind}, n long, most double, mass double, best double, total double, own double, "
        f"near array<struct<id:{kind},s:double>>"
    )
    names = ["batch_id", "side", id_col, "n", "most", "mass", "best", "total", "own", "near"]
    both, key = sides[0].unionByName(sides[1]), ("batch_id", "_i", "_j")
    whole = min(n, batch_size)
    if whole > BLOCK:
        # products weigh more than the bytes that partitions are put together by
        cells = max(min(-(-whole // BLOCK), SIDE), -(-whole // LARGEST)) ** 2 * -(-n // whole)
        both = both.repartition(min(cells, -(-n * whole // PRODUCTS)), *key)
    return both.groupBy(*key).applyInPandas(meet, schema)


def merged_states(states: DataFrame, id_col: str = "id", top: int = 0) -> DataFrame:
    """One state per side, batch and id: ``n, log_mass`` (log of the sum of exponentials), ``best, total, own, near``."""
    own = F.max(F.when(~F.isnan("own"), F.col("own"))).alias("own")
    merged = states.groupBy("batch_id", "side", id_col).agg(
        F.sum("n").alias("n"), F.max("most").alias("_most"), F.collect_list(F.struct("most", "mass")).alias("_parts"),
        F.max("best").alias("best"), F.sum("total").alias("total"), own, F.flatten(F.collect_list("near")).alias("near"),
    )
    mass = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["mass"] * F.exp(p["most"] - F.col("_most")))
    first = F.array_sort(
        "near",
        lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0),
    )
    return merged.select(
        "batch_id", "side", id_col, "n", (F.col("_most") + F.log(mass)).alias("log_mass"), "best", "total", "own",
        F.slice(first, 1, top).alias("near") if top else F.col("near"),
    )


def batch_similarities(pairs: DataFrame, batch_size: int, seed: int, id_col: str = "id", top: int = 5) -> DataFrame:
    """Cosine similarities of each anchor ``a`` with the ``b`` of its batch: ``own``, how many there are (``n``), the
    ``best``, their ``total`` and the ``top`` nearest (``near``: id and similarity). No row holds a whole batch."""
    found = merged_states(block_states(pairs.select(id_col, "a", "b"), batch_size, seed, 1.0, id_col, top), id_col, top)
    return found.filter("side = 'a'").drop("side", "log_mass")


def info_nce(
    pairs: DataFrame, batch_size: int, seed: int, temperature: float = TEMPERATURE, id_col: str = "id"
) -> DataFrame:
    """Symmetric contrastive loss per batch between vectors ``a`` and ``b`` of the same row. A batch may be of any size."""
    found = merged_states(block_states(pairs.select(id_col, "a", "b"), batch_size, seed, temperature, id_col), id_col)
    loss = F.avg(F.col("log_mass") - F.col("own") / temperature)
    sides = found.groupBy("batch_id", "side").agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"))
    return sides.groupBy("batch_id").agg(F.max("n").alias("n"), F.avg("loss").alias("loss"))


def info_nce_hard(
    pairs: DataFrame, batch_size: int, seed: int, temperature: float = TEMPERATURE, id_col: str = "id"
) -> DataFrame:
    """One-way contrastive loss with an explicit hard negative ``hard`` per anchor.

    Without a ``hard`` column this is the plain loss.
    """
    if "hard" not in pairs.columns:
        return info_nce(pairs, batch_size, seed, temperature, id_col)
    found = merged_states(block_states(pairs.select(id_col, "a", "b", "hard"), batch_size, seed, temperature, id_col), id_col)
    loss = F.avg(F.col("log_mass") - F.col("own") / temperature)
    return found.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("loss"))


def pca(df: DataFrame, vector: str, k: int = 2, prefix: str = "pc") -> DataFrame:
    """Centred projection on the first ``k`` components.

    The fit aggregates a d x d matrix. Each component's sign makes its largest loading positive.
    """
    vectors = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    mean = vector_to_array(vectors.agg(Summarizer.mean(F.col("_v")).alias("m")).scalar())
    centred = F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)
    axes = {
        f"{prefix}{i + 1}": dot(F.col("_centred"), F.array(*[F.lit(float(w)) for w in loadings[:, i] * signs[i]]))
        for i in range(k)
    }
    return df.withColumn("_mean", mean).withColumn("_centred", centred).withColumns(axes).drop("_mean", "_centred")


def cosine_silhouette(
    df: DataFrame, vector: str, label: str, labels: Sequence[object], more_than: int | None = None
) -> DataFrame:
    """Silhouette with cosine distance per point, in one pass over cluster sums.

    The mean distance from a unit vector to a cluster is 1 minus its dot product with the
    cluster's mean, so points are never paired. ``labels`` bounds the clusters; ``n_label`` is the size of the point's own.
    With ``more_than``, nothing comes back unless all clusters together have more rows than that.
    """
    rows = df.filter(F.col(label).isin(*labels)).withColumn("_u", l2_normalize(F.col(vector)))
    sums = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector("_u"))).alias("s"),
    )
    clusters = sums.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "s"))).scalar()
    apart = F.transform(
        "_clusters",
        lambda c: F.struct(c["l"].alias("l"), c["n"].alias("n"), (c["n"] - dot(F.col("_u"), c["s"])).alias("d")),
    )
    own = F.filter("_apart", lambda c: c["l"] == F.col(label))[0]
    a = own["d"] / (own["n"] - 1)
    b = F.array_min(
        F.transform(F.filter("_apart", lambda c: c["l"] != F.col(label)), lambda c: c["d"] / c["n"])
    )
    placed = rows.withColumn("_clusters", clusters)
    if more_than is not None:
        # the sums know how many rows there are
        placed = placed.filter(F.aggregate("_clusters", F.lit(0).cast("long"), lambda t, c: t + c["n"]) > more_than)
    placed = placed.withColumn("_apart", apart).withColumn("n_label", own["n"])
    score = F.when(own["n"] == 1, F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return (
        placed.withColumn("_a", F.when(own["n"] > 1, a))
        .withColumn("_b", b)
        .withColumn("silhouette", score)
        .drop("_u", "_clusters", "_apart", "_a", "_b")
    )


def type_report(
    embeddings: DataFrame,
    accounts: DataFrame,
    vector: str = "embedding",
    id_col: str = "id",
    types: Sequence[str] = MAIN_TYPES,
    min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """How well embeddings tell account types apart: ``id, type, n_type, pc1, pc2, silhouette``, one row per account of a
    known type.

    The projection is fitted on all known types. The silhouette is among the main types, and null for the others and
    where there are not more than ``min_samples`` of the main ones, as ``cosine_silhouette`` decides from its cluster
    sums. The typed vectors are written once, as fit and report read them.
    """
    typed = stored(known_types(with_account_types(embeddings.select(id_col, vector), accounts, id_col)), "typed")
    if typed.isEmpty():
        nothing = {"n_type": "long", "pc1": "double", "pc2": "double", "silhouette": "double"}
        return typed.select(id_col, "type", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    counts = typed.groupBy("type").agg(F.count(F.lit(1)).alias("n_type"))
    scores = cosine_silhouette(typed, vector, "type", types, min_samples).select(id_col, "silhouette")
    # as many rows as types
    placed = pca(typed, vector).join(F.broadcast(counts), "type").join(scores, id_col, "left")
    return placed.select(id_col, "type", "n_type", "pc1", "pc2", "silhouette")


def silhouette_by_type(report: DataFrame) -> DataFrame:
    """The report's totals: rows and mean silhouette of every type."""
    return report.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))
