"""Near-duplicate classes by exact Jaccard similarity of word shingles.

SimHash with the anchor cover of ``simhash`` proposes first: every set has a fingerprint of 64 bits, and all fingerprints within
``REACH`` bits are found through the anchors. What it proposes is verified on the whole sets. No number of bits bounds a
Jaccard similarity, though, so pairs that the cover cannot reach are left, and an exact way finds these.

That way is prefix filtering. With every set in one common order, two sets of n and m shingles that are similar
enough share one of the first n - ceil(s n) + 1 and m - ceil(s m) + 1; so only these *prefixes* are indexed, and no link can
be missed. Any order is right. The one used puts shingles that many documents share at the end, so that texts which
have no more than a passage or a template in common do not meet; it is learnt from the shingles of at most ``SAMPLE``
documents, and a poor estimate costs comparisons, never links.

An entry of the index (a shingle with its members) is not expanded into pairs. In rounds, some members of every entry
become its hubs and are compared with those members that are not in their class yet; then they leave the entry. Entries
whose members are all of one class are done. The first round has one hub for each entry. A later one has twice as many as the
one before, or as many more as keep its members times hubs below the size of the index. So a group of copies costs a
comparison for each member, and members that do not link are compared until none is left: nothing is lost. Members that the cover has linked are of one
class from the start.

Pairs whose lengths or places in the order rule a link out are not compared, nor are those told apart by their bitmaps: a
bit is the parity of the shingles whose hash falls on it, so two sets differ in as many shingles at least as their
bitmaps in bits. What is left is verified on the whole sets.

A broadcast table whose key is not one whole number takes a page of memory (32 MB on a small executor) however few rows it
has, and keeps it until the driver collects its garbage; with several in each round, they would fill the executors. So
only tables keyed by one whole number are broadcast here, and joins by two columns are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_GROUPS, binary_text, join_groups, saved, saved_more, slices
from .components import components
from .simhash import links

#: Bits within which the anchor cover finds all fingerprints.
REACH = 2
#: Documents whose shingles the order is learnt from, and how many common shingles it keeps (6 MB).
SAMPLE, COMMON = 20_000, 500_000
#: Bits of a bitmap; rows of keys that are broadcast at most (some 12 MB), beyond them texts are shuffled instead.
BITS, FEW = 1024, 200_000
#: Comparisons of one document that meet in a task.
MEETING = 512


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of ``words`` words, or of the whole text where it has fewer. Words are split
    at ASCII white space, A-Z lowered."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    step = min(words, len(found)) - 1
    line = b" ".join(found)
    hashes = [xxhash.xxh64_digest(line[a:b], 42) for a, b in zip(starts[: len(found) - step].tolist(), ends[step:].tolist())]
    return np.unique(np.frombuffer(b"".join(hashes), np.uint64))


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order (rare ones first, then by hash): as many as a link needs."""
    hashes, counts = common
    n = len(found)
    if not n:
        return found
    at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
    often = np.where(hashes[at] == found, counts[at], 0) if len(hashes) else np.zeros(n, np.int64)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return found[np.lexsort((found, often))[:most]]


def bitmap(found: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each bit, as whole numbers of 64 bits."""
    odd = np.bincount((found >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set as a signed number: the bits that are set in over half of its hashes. That of the empty set is zero."""
    bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(bits)).view(">i8")[0])


def _sampled(docs: DataFrame, words: int, text: str, key: str, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the ``COMMON`` commonest shingles among at most about ``SAMPLE`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "_text"):
                sets = [shingles(v, words) for v in part.column("_text").to_pylist()]
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                found, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    share = max(1, -(-total // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(binary_text(text).alias("_text"))
    # most shingles are met once, so counting them before the shuffle would fill each task's memory and save little
    counts = some.mapInArrow(run, "hash bigint, n bigint").repartition("hash").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def node(found: np.ndarray) -> int:
    """The number of a set, as a signed one."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _signatures(docs: DataFrame, words: int, similarity: float, text: str, key: str, common) -> DataFrame:
    """``key, node, n, bits, fp, prefix``: equal sets have the same node; the empty set has no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = common.value
        for batch in slices(batches, "_text"):
            sets = [shingles(v, words) for v in batch.column("_text").to_pylist()]
            nodes = [node(s) for s in sets]
            first = [prefix(s, order, similarity).view(np.int64) for s in sets]
            columns = [
                batch.column(key),
                pa.array(nodes, pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.array(first, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "node", "n", "bits", "fp", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, node bigint, n int, bits array<bigint>, fp bigint, prefix array<bigint>"
    return docs.select(key, binary_text(text).alias("_text")).mapInArrow(run, shape)


def _sets(docs: DataFrame, words: int, text: str) -> DataFrame:
    """``node, set`` of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingles(v, words) for v in batch.column("_text").to_pylist()]
            columns = [pa.array([node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "set"])

    return docs.select(binary_text(text).alias("_text")).mapInArrow(run, "node bigint, set array<bigint>")


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``join_groups`` with saved groups: one plain join where none of them is hot."""
    if groups.where(F.col(size) * HOT_GROUPS > total).isEmpty():
        return rows.join(groups, keys)
    return join_groups(rows, groups, keys, size, total)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) whose sets have a Jaccard similarity of ``similarity`` at least. The set of a node
    in many pairs is repeated, so no more than ``MEETING`` of them or so meet in one task."""
    total = max(pairs.count(), 1)
    out = pairs
    for side, other in (("b", "a"), ("a", "b")):
        degree = pairs.groupBy(side).agg(F.count("*").alias("_n"))
        degree = saved(degree.withColumn("_parts", F.ceil(F.col("_n") / MEETING).cast("int")), "degrees")
        known = degree.join(sets.withColumnsRenamed({"node": side, "set": f"_{side}"}), side)
        known = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_n", "_parts")
        dealt = _joined(out, degree, [side], "_n", total).drop("_n")
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(other), F.col("_parts")).cast("int")).drop("_parts")
        out = dealt.hint("merge").join(known, [side, "_part"]).drop("_part")
    both = F.size(F.array_intersect("_a", "_b"))
    share = both / (F.size("_a") + F.size("_b") - both)
    return out.where(share >= similarity).select("a", "b")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` whose bitmaps (``bits`` and ``n`` of ``nodes``) do not rule a link out."""
    total, out = max(pairs.count(), 1), pairs
    for side in ("a", "b"):
        degree = pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("_n"))
        known = saved(degree.join(nodes.select("node", "n", "bits"), "node"), "bitmaps")
        known = known.withColumnsRenamed({"node": side, "n": f"_size_{side}", "bits": f"_bits_{side}"})
        out = _joined(out, known, [side], "_n", total).drop("_n")
    apart = F.aggregate(
        F.zip_with("_bits_a", "_bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n
    )
    both = F.col("_size_a") + F.col("_size_b")
    return out.where((both - apart) / 2 >= similarity / (1 + similarity) * both - 1e-9).select("a", "b")


def anchored(nodes: DataFrame, reach: int) -> DataFrame:
    """``a, b``: the pairs of nodes that the anchor cover proposes. The smallest node of a fingerprint (``fp``) meets
    those of all fingerprints within ``reach`` bits, and the others with its own."""
    total = max(nodes.count(), 1)
    prints = saved(nodes.groupBy("fp").agg(F.min("node").alias("_hub"), F.count("*").alias("_n")), "prints")
    own = _joined(nodes.select("fp", "node"), prints.where("_n > 1"), ["fp"], "_n", total).where("node != _hub")
    hub = lambda side: prints.select(F.col("fp").alias(side), F.col("_hub").alias(f"_hub_{side}"))
    near = links(prints.select("fp"), reach).join(hub("a"), "a").join(hub("b"), "b")
    ends = (F.least("_hub_a", "_hub_b").alias("a"), F.greatest("_hub_a", "_hub_b").alias("b"))
    return near.select(*ends).union(own.select(F.col("_hub").alias("a"), F.col("node").alias("b")))


def _pairs(active: DataFrame, turn: int, most: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The members of entries that are not of one class yet, this round's hubs among them (``hash, node``) and the pairs
    (``a``, ``b``) that they have to be compared in."""
    entries = active.groupBy("hash").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n"))
    mixed = saved(entries.where("_low < _high").select("hash", "_n"), "mixed")
    total = max(active.count(), 1)
    left = saved(_joined(active, mixed, ["hash"], "_n", total), "mixed-members")
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(max(2**turn, most // max(left.count(), 1))))
    hubs = left.groupBy("hash", "_n", part.alias("_part")).agg(F.min(F.struct("node", "n", "place", "root")).alias("_hub"))
    hubs = saved(hubs.select("hash", "_n", "_hub"), "hubs")
    both = _joined(left.drop("_n"), hubs, ["hash"], "_n", total)
    n, m, i, j = F.col("n"), F.col("_hub.n"), F.col("place"), F.col("_hub.place")
    apart = (F.col("root") != F.col("_hub.root")) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)
    # what both hold from here on; a pair that shares an earlier shingle is judged by that one
    rest = F.least(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-9
    ends = (F.least("node", "_hub.node").alias("a"), F.greatest("node", "_hub.node").alias("b"))
    return left.drop("_n"), hubs.select("hash", F.col("_hub.node").alias("node")), both.where(apart & rest).select(*ends).distinct()


def near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, component_id``: one row per row of ``docs``.

    Documents are linked when the sets of their ``words``-word shingles have a Jaccard similarity of ``similarity``
    at least; ``component_id`` is the smallest key reachable over links (its own included). All links count, none is
    missed. Equal sets are one node, texts without a word (null and empty ones) among them. Keys are compared, so they
    must not be null and must differ from row to row; the smallest names the class, so there are no ties. A very long text is one array of 8 bytes a shingle in its
    task. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    common = docs.sparkSession.sparkContext.broadcast(_sampled(docs, words, text, key, docs.count()))
    rows = saved(_signatures(docs, words, similarity, text, key, common), "signatures")
    common.unpersist()
    total = max(rows.count(), 1)
    nodes = rows.groupBy("node").agg(
        F.min(key).alias("_first"), F.count("*").alias("_rows"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp")
    )
    nodes = saved(nodes, "nodes")
    entries = rows.select("node", "n", F.posexplode("prefix").alias("place", "hash"))
    crowd = entries.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1")
    crowd = saved(crowd, "crowds")
    members = _joined(entries, crowd, ["hash"], "_n", max(entries.count(), 1)).select("hash", "node", "n", "place")
    held, compared = [], []

    def linked(pairs: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        """The roots once the pairs that are links have been added."""
        pairs = saved(likely(pairs, nodes, similarity), "likely")
        if pairs.isEmpty():
            return roots
        known = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if held:
            known = known.join(docs.sparkSession.read.parquet(*held), "node", "left_anti")
        # found by the hash of their key: another text that has it gives one set more, which no pair asks for
        reps = saved(known.join(nodes, "node").select(F.xxhash64("_first").alias("_hash")).distinct(), "representatives")
        reps = F.broadcast(reps) if reps.count() <= FEW else reps
        chosen = docs.select(F.xxhash64(key).alias("_hash"), F.col(text).alias("_text")).join(reps, "_hash", "left_semi")
        _, sets = saved_more(_sets(chosen, words, "_text"), "sets", held)
        near = saved(similar(pairs, sets, similarity), "near")
        if near.isEmpty():
            return roots
        # earlier links count as one from each node to its root
        return components(near if roots is None else near.union(roots.where("node != root").toDF("a", "b")))

    def rooted(active: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return active.withColumn("root", F.col("node"))
        return active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs, seen = saved_more(anchored(nodes, REACH), "pairs", compared)
    roots = linked(pairs, None)
    active, turn = saved(rooted(members.distinct(), roots), "members"), 0
    most = active.count()
    while True:
        # classes only grow, so an entry of one class is done
        active, hubs, pairs = _pairs(active, turn, most, similarity)
        if hubs.isEmpty():
            break
        pairs, seen = saved_more(pairs.join(seen.hint("merge"), ["a", "b"], "left_anti"), "pairs", compared)
        was, roots = roots, linked(pairs, roots)
        active = active.join(hubs.hint("merge"), ["hash", "node"], "left_anti")
        active = saved(active if roots is was else rooted(active.drop("root"), roots), "members")
        turn += 1

    nodes = nodes.drop("n", "bits", "fp")
    placed = nodes if roots is None else nodes.join(roots, "node", "left")
    root = F.col("node") if roots is None else F.coalesce("root", "node")
    placed = saved(placed.withColumn("root", root), "placed")
    least = placed.groupBy("root").agg(F.min("_first").alias("component_id"), F.count("*").alias("_nodes"))
    least = saved(least, "least")
    classes = _joined(placed, least, ["root"], "_nodes", max(placed.count(), 1))
    classes = saved(classes.select("node", "component_id", "_rows"), "classes")
    return _joined(rows.drop("prefix", "n", "bits", "fp"), classes, ["node"], "_rows", total).select(key, "component_id")
