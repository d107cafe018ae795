"""SimHash near-duplicate classes by anchor-point covering.

Every text gets a 64-bit SimHash of its word shingles. Links are all pairs of fingerprints that differ in
at most ``max_bits`` bits. They are found without comparing all pairs: the codewords of a covering code are
anchors. 46 of the 64 bits are two words of the perfect Golay code [23, 12], whose covering radius is 3, so each
fingerprint has one *home* anchor, at distance at most 3 in either word. If ``y`` differs from ``x`` in ``e1``
and ``e2`` bits of the two words, ``y`` lies within ``3 + e1`` and ``3 + e2`` of the home of ``x``. So each
fingerprint is replicated to every anchor whose distances exceed 3 by ``max_bits`` at most in total, and the
homes and the replicas of one anchor are compared exactly, on all 64 bits. No link is lost.

The number of replicas is a constant of the code (61 on average for two bits), and a fingerprint has at most
C(64, 1) + C(64, 2) others within two bits, so links grow in proportion to the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, join_groups, saved, slices
from .components import components

RADIUS, WORD, TAIL = 3, 23, 11
#: The generator polynomial of the Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, words: int) -> bytes:
    """Eight bytes, most significant first. Texts without a word have fingerprint zero."""
    found = text.lower().split()
    if not found:
        return bytes(8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    step = min(words, len(found)) - 1
    line = b" ".join(found)
    hashes = b"".join(
        [xxhash.xxh64_digest(line[a:b], 42) for a, b in zip(starts[: len(found) - step].tolist(), ends[step:].tolist())]
    )
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp``: the SimHash of every row as a signed long. Words are split at ASCII white space, A-Z lowered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            joined = b"".join(fingerprint(t, words) for t in batch.column("_text").to_pylist())
            out = pa.array(np.frombuffer(joined, ">i8").astype("i8"))
            yield pa.RecordBatch.from_arrays([batch.column(key), out], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, binary_text(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator; zero for codewords."""
    out = words.astype(np.int64)
    for bit in range(WORD - 1, TAIL - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - TAIL)), out)
    return out


@lru_cache
def cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit patterns of weight at most ``reach``, grouped by syndrome: patterns, weights, and where each group starts."""
    patterns = np.array([sum(1 << b for b in c) for w in range(reach + 1) for c in combinations(range(WORD), w)])
    weights = np.bitwise_count(patterns).astype(np.int64)
    groups = syndromes(patterns)
    order = np.lexsort((weights, groups))
    starts = np.searchsorted(groups[order], np.arange((1 << TAIL) + 1))
    return patterns[order], weights[order], starts


def _near(word: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word the codewords within reach: row, codeword, and by how much its distance exceeds the radius."""
    patterns, weights, starts = cosets(RADIUS + max_bits)
    group = syndromes(word)
    n = starts[group + 1] - starts[group]
    row = np.repeat(np.arange(len(word)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[group][row]
    return row, word[row] ^ patterns[at], np.maximum(weights[at] - RADIUS, 0)


def home_anchors(fp: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius, for each fingerprint."""
    patterns, _, starts = cosets(RADIUS)
    mask = (1 << WORD) - 1
    first, second = fp & mask, fp >> WORD & mask
    code = [w ^ patterns[starts[syndromes(w)]] for w in (first, second)]
    return code[1] << WORD | code[0]


def all_anchors(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor that may be the home of a fingerprint within ``max_bits``: row numbers and anchors."""
    mask = (1 << WORD) - 1
    row1, code1, over1 = _near(fp & mask, max_bits)
    row2, code2, over2 = _near(fp >> WORD & mask, max_bits)
    starts = np.searchsorted(row2, np.arange(len(fp) + 1))
    n = (starts[1:] - starts[:-1])[row1]
    left = np.repeat(np.arange(len(row1)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + starts[row1][left]
    keep = over1[left] + over2[right] <= max_bits
    left, right = left[keep], right[keep]
    return row1[left], code2[right] << WORD | code1[left]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a, b``: every pair of different fingerprints of ``distinct`` (column ``fp``) within ``max_bits``, once."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp)), batch.column("fp")], ["anchor", "a"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                fp = batch.slice(i, 2000).column("fp").to_numpy()
                row, anchor = all_anchors(fp, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["anchor", "b"])

    left = distinct.mapInArrow(homes, "anchor bigint, a bigint")
    right = distinct.mapInArrow(replicas, "anchor bigint, b bigint")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # replicas look small to the optimizer, which does not know how many a fingerprint has: never broadcast them
    right = right.hint("merge")
    return left.alias("l").join(right.alias("r"), (F.col("l.anchor") == F.col("r.anchor")) & close).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 2, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, fingerprint, component_id, links``: one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest key reachable over links (its own
    included), ``links`` the number of other fingerprints within ``max_bits``. Equal fingerprints are one
    node, so copies are never paired. Null texts count as empty; empty texts have fingerprint zero and are
    linked like any other. Rows with a null key keep it; a class of such rows only has a null
    ``component_id``. Repeated rows give repeated rows. A very long text is hashed by one
    task, its shingles in slices. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    rows = saved(fingerprints(docs, words, text, key), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min(key).alias("_first"), F.count("*").alias("_rows")), "nodes")
    pairs = saved(links(nodes.select("fp"), max_bits), "pairs")
    degree = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("links"))
    roots = components(pairs).join(degree.withColumnRenamed("fp", "node"), "node").withColumnRenamed("node", "fp")
    placed = saved(
        nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).na.fill(0, ["links"]), "placed"
    )
    least = placed.groupBy("root").agg(F.min("_first").alias("component_id"), F.count("*").alias("_nodes"))
    total = rows.count()
    classes = join_groups(placed, least, ["root"], "_nodes", max(placed.count(), 1))
    classes = saved(classes.select("fp", "component_id", "links", "_rows"), "classes")
    out = join_groups(rows, classes, ["fp"], "_rows", max(total, 1))
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
