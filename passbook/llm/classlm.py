"""A class-based n-gram language model in the manner of Brown et al., with classes by distributed exchange.

Words are counted over all training texts. The exchange moves each word to the class that makes the class
bigrams likeliest while all other words stay, from counts of the classes before and after it; words with
even and odd numbers take turns, so that neighbours do not swap for ever. It runs over the texts with
every word number, first for a core of frequent words, and then once more for each sort of the others:
frequent words, of which a bounded number is broadcast, and the rest, which meet their counts in a join. No word of
the rest can be hot, because hot words are frequent.

The probability of a word is P(class | two classes before) times P(word | class). Class trigrams are interpolated
with bigrams and unigrams by Witten and Bell's weights. Inside a class, a fixed discount is taken from every word's
count and kept for words never seen, which are one symbol more, so that all probabilities after a history add up
to one. Unseen words leave the history as it is. The end of a text is a class of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_text, saved, slices

#: Word counts that a task holds before it hands them on.
HELD = 400_000


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n_all, n_train`` from rows of ``_text, _train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            train = np.fromiter((seen[1][w] for w in words), np.int64, len(words))
            other = np.fromiter((seen[0][w] for w in words), np.int64, len(words))
            for c in seen:
                c.clear()
            columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(train + other), pa.array(train)]
            return pa.RecordBatch.from_arrays(columns, ["word", "n_all", "n_train"])

        for batch in slices(batches, "_text"):
            for text, train in zip(batch.column("_text").to_pylist(), batch.column("_train").to_pylist()):
                seen[train].update(tokens_of(text))
            if len(seen[0]) + len(seen[1]) > HELD:
                yield rows()
        yield rows()

    counted = docs.select("_text", "_train").mapInArrow(run, "word string, n_all bigint, n_train bigint")
    return counted.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def frequent_words(counts: DataFrame, most: int) -> list:
    """The words with the greatest counts, ``most`` at most, in order. Where to cut is read off a histogram of counts
    that has a fixed number of bars."""
    bar = F.floor(F.log2("n_all") * 32).alias("bar")
    bars = counts.groupBy(bar).agg(F.count("*").alias("words")).orderBy(F.desc("bar")).collect()
    held, least = 0, None
    for r in bars:
        if held + r.words > most:
            break
        held, least = held + r.words, r.bar
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("n_all") * 32) >= least).collect()
    return sorted(rows, key=lambda r: (-r.n_all, r.word))


def encode(docs: DataFrame, numbers) -> DataFrame:
    """``_row, _key, _held, ids, rare`` from ``_row, _key, _held, _text``: words as numbers; other words as minus their
    place (from 1) in ``rare``, which holds each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in slices(batches, "_text"):
            ids, rare = [], []
            for text in batch.column("_text").to_pylist():
                own: dict[bytes, int] = {}
                row = []
                for w in tokens_of(text):
                    i = known.get(w)
                    row.append(own.setdefault(w, -len(own) - 1) if i is None else i)
                ids.append(np.array(row, "<i4").tobytes())
                rare.append(list(own))
            columns = [batch.column(c) for c in ("_row", "_key", "_held")]
            columns += [pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_key", "_held", "ids", "rare"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row bigint, _key {kind}, _held boolean, ids binary, rare array<string>")


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch one after the other, and how many each row has."""
    bodies = column.to_pylist()
    return np.frombuffer(b"".join(bodies), "<i4"), np.array([len(b) // 4 for b in bodies], np.int64)


def _with_ends(classes: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The classes of all rows with ``end`` before, between and after them."""
    out = np.full(len(classes) + len(sizes) + 1, end, np.int32)
    inside = np.ones(len(out), bool)
    inside[0] = inside[np.cumsum(sizes + 1)] = False
    out[inside] = classes
    return out


def context_counts(encoded: DataFrame, classes, first: int, last: int, k: int) -> DataFrame:
    """For the words numbered ``first`` to ``last``: how often each class stands before (``l``) and after (``r``) them.
    Class ``k`` is any word without a class, ``k + 1`` the end of a text."""
    width = k + 2
    names = [f"{s}{c}" for s in "lr" for c in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the classes of an end (-2) and of a word without a number (-1) come before those of numbered words
        of = np.append(np.array([k + 1, k], np.int32), classes.value.astype(np.int32))
        sums = np.zeros((2, (last - first) * width), np.int64)
        for batch in batches:
            ids, sizes = _sequence(batch.column("ids"))
            word = _with_ends(np.maximum(ids, -1), sizes, -2)
            group = of[word + 2]
            at = np.flatnonzero((word >= first) & (word < last))
            own = (word[at] - first) * width
            for side, by in ((0, -1), (1, 1)):
                sums[side] += np.bincount(own + group[at + by], minlength=sums.shape[1])
        table = sums.reshape(2, -1, width)
        used = np.flatnonzero(table[0].any(axis=1))
        columns = [pa.array((used + first).astype("i4"))] + [pa.array(table[s, used, c]) for s in (0, 1) for c in range(width)]
        yield pa.RecordBatch.from_arrays(columns, ["word", *names])

    schema = "word int, " + ", ".join(f"{n} bigint" for n in names)
    counted = encoded.where("NOT _held").select("ids").mapInArrow(run, schema)
    return counted.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def _moves(before: np.ndarray, after: np.ndarray, joint: np.ndarray, k: int) -> np.ndarray:
    """The gain in log-likelihood of putting words with those contexts into each class, all other words staying."""
    log = np.log(joint + 0.5)
    size = np.log(joint.sum(axis=1)[:k] + 0.5 * (k + 2))
    n = before.sum(axis=1)
    return before @ log[:, :k] + after @ log[:k].T - 2 * n[:, None] * size


def exchange(encoded: DataFrame, core: int, words: int, k: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every numbered word, and the counts of class pairs among core words at the last pass."""
    context = encoded.sparkSession.sparkContext
    core = min(core, words)
    classes = np.full(max(words, 1), k, np.int32)
    # many words of a class are needed for contexts to differ, and neighbours in frequency should not start together
    classes[:core] = np.arange(core) % k
    joint = np.zeros((k + 2, k + 2))
    for turn in range(2 * passes):
        before, after = _contexts(encoded, context.broadcast(classes), 0, core, k)
        joint = _joint(before, after, classes[:core], k)
        best = _moves(before, after, joint, k).argmax(axis=1)
        move = (np.arange(core) % 2 == turn % 2) & (best != classes[:core])
        classes[:core][move] = best[move]
        if turn and move.sum() <= core // 500:
            break
    before, after = _contexts(encoded, context.broadcast(classes), 0, core, k)
    joint = _joint(before, after, classes[:core], k)
    if words > core:
        before, after = _contexts(encoded, context.broadcast(classes), core, words, k)
        classes[core:words] = _moves(before, after, joint, k).argmax(axis=1)
    return classes, joint


def _contexts(encoded, classes, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, last - first, k + 2))
    rows = context_counts(encoded, classes, first, last, k).toArrow()
    at = rows.column("word").to_numpy() - first
    for s, side in enumerate("lr"):
        for c in range(k + 2):
            out[s, at, c] = rows.column(f"{side}{c}").to_numpy()
    return out[0], out[1]


def _joint(before: np.ndarray, after: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class pairs, from the contexts of all core words."""
    joint = np.zeros((k + 2, k + 2))
    for c in range(k):
        joint[:, c] = before[classes == c].sum(axis=0)
        joint[c, k:] = after[classes == c].sum(axis=0)[k:]
    return joint


@dataclass(frozen=True)
class ClassModel:
    """Log10 probabilities of a class and of an unseen word after two classes, and what emissions need."""

    k: int
    discount: float
    sizes: np.ndarray  # tokens of each class, and of the end
    transition: np.ndarray  # log10 P(class | second last, last); classes 0..k-1, end k; history k + 1 is the start
    unseen: np.ndarray  # log10 P(unseen word | second last, last)


def build_model(trigrams: np.ndarray, types: np.ndarray, n1: int, n2: int, k: int) -> ClassModel:
    """``trigrams[h2, h1, c]`` over k classes, the end (k) and the start (k + 1); ``types``: distinct words of each class."""
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    counts = trigrams[:, :, : k + 1].astype(float)
    uni = counts.sum(axis=(0, 1))
    p1 = uni / max(uni.sum(), 1)

    def mixed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        n, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        return (c + kinds * lower) / np.maximum(n + kinds, 1) + np.where(n == 0, lower, 0)

    p2 = mixed(counts.sum(axis=0), p1)
    p3 = mixed(counts, p2[None])
    left = np.append(discount * types / np.maximum(uni[:k], 1), 0.0)
    with np.errstate(divide="ignore"):
        return ClassModel(k, discount, uni, np.log10(p3), np.log10(p3 @ left))


def _classes_and_counts(batch: pa.RecordBatch, of: np.ndarray, count: np.ndarray):
    """For all words of a batch their class and training count; rows' sizes."""
    ids, sizes = _sequence(batch.column("ids"))
    many, some = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
    if len(some):
        # a row's rare words are numbered -1, -2, ...
        many[some] = np.maximum(-np.minimum.reduceat(ids, np.cumsum(sizes[some]) - sizes[some]), 0)
    first = np.cumsum(many) - many
    base = np.repeat(first, sizes)
    own_class, own_count = np.zeros((2, int(many.sum()) + 1), np.int64)
    found = batch.column("found")
    flat = found.flatten()
    place = first[pc.list_parent_indices(found).to_numpy()] + pc.struct_field(flat, "place").to_numpy()
    own_class[place] = pc.struct_field(flat, "group").to_numpy()
    own_count[place] = pc.struct_field(flat, "n_train").to_numpy()
    rare = ids < 0
    at = np.where(rare, base - ids - 1, 0)
    number = np.maximum(ids, 0)
    return np.where(rare, own_class[at], of[number]), np.where(rare, own_count[at], count[number]), sizes


def _histories(group: np.ndarray, known: np.ndarray, sizes: np.ndarray, k: int):
    """For every word and every end of a text: the two known classes before it (k + 1 where the text has begun), its class,
    whether it is known, and its row."""
    rows = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    c = np.full(len(rows), k, np.int64)
    seen = np.ones(len(rows), bool)
    inside = np.ones(len(rows), bool)
    inside[ends] = False
    c[inside], seen[inside] = group, known
    # among known words: the last two of the same row
    at = np.flatnonzero(seen)
    upto = np.cumsum(seen) - seen  # known words before each
    out = []
    for back in (2, 1):
        i = upto - back
        j = at[np.maximum(i, 0)]
        ok = (i >= 0) & (rows[j] == rows)
        out.append(np.where(ok, c[j], k + 1))
    return out[0], out[1], c, seen, rows


def score_texts(
    docs: DataFrame,
    held_out: Column,
    k: int = 16,
    core: int = 8192,
    most: int = 150_000,
    passes: int = 5,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    The model learns from the rows for which ``held_out`` is not true. ``base_score`` is that of single words with
    one added to every count, ``score`` the class model's log10 probability of the text and its end. ``most``
    bounds the words that are broadcast and ``core`` those that iterate; all words get a class. Null texts
    count as empty. Null and repeated keys are kept as they are. Without any training row both scores are 0.
    Equal counts are ordered by the word. A very long text is scored as a whole by one task. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), binary_text(text).alias("_text")
    )
    read = read.withColumn("_train", ~F.col("_held"))
    counts = saved(word_counts(read), "word-counts")
    one = lambda n: F.count_if(F.col("n_train") == n)
    total = counts.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0), one(1), one(2)).first()
    train_rows = read.where("_train").count()
    n_train, types = (total[0] or 0) + train_rows, total[1] + (train_rows > 0)
    words = frequent_words(counts, most)
    numbers = spark.sparkContext.broadcast({r.word.encode(): i for i, r in enumerate(words)})
    encoded = saved(
        encode(read.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_key", "_held", "_text"), numbers),
        "encoded",
    )
    classes, joint = exchange(encoded, core, len(words), k, passes)
    classes = np.where(classes < k, classes, 0)
    shared = spark.sparkContext.broadcast((classes, np.array([r.n_train for r in words] or [0], np.int64)))
    rare = _place_rare(encoded, counts, shared, joint, k)
    encoded = _with_rare(encoded, rare)
    trigrams = _trigrams(encoded, shared, k)
    kinds = np.bincount(classes[: len(words)], weights=[r.n_train > 0 for r in words], minlength=k)[:k] if words else np.zeros(k)
    for r in rare.where("n_train > 0").groupBy("group").agg(F.count("*").alias("n")).collect():
        kinds[r.group] += r.n
    model = spark.sparkContext.broadcast(build_model(trigrams, kinds, total[2], total[3], k))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (of, count) = model.value, shared.value
        base_of = np.log10(n_train + types + 1)
        for batch in batches:
            group, n, sizes = _classes_and_counts(batch, of, count)
            h2, h1, c, seen, rows = _histories(group, n > 0, sizes, k)
            every = np.full(len(rows), train_rows, np.int64)
            inside = np.ones(len(rows), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            every[inside] = n
            with np.errstate(divide="ignore"):
                word = np.where(inside, np.log10(np.maximum(every - m.discount, 1e-300)) - np.log10(np.maximum(m.sizes[c], 1)), 0)
            got = np.where(seen, m.transition[h2, h1, c] + word, m.unseen[h2, h1])
            total = np.bincount(rows, got, len(sizes)) if n_train else np.zeros(len(sizes))
            base = np.bincount(rows, np.log10(every + 1.0) - base_of, len(sizes))
            known = np.bincount(rows, every > 0, len(sizes)).astype(np.int64)
            columns = [batch.column("_key"), batch.column("_held"), pa.array(sizes + 1), pa.array(known)]
            columns += [pa.array(np.full(len(sizes), n_train)), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays(
                columns, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            )

    return encoded.mapInArrow(
        run,
        f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )


def _place_rare(encoded: DataFrame, counts: DataFrame, shared, joint: np.ndarray, k: int) -> DataFrame:
    """``word, n_train, group``: the class of every word that has no number, by one step of the exchange."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        for batch in batches:
            ids, sizes = _sequence(batch.column("ids"))
            lists = batch.column("rare")
            many = np.diff(lists.offsets.to_numpy())
            words = lists.flatten()
            base = np.repeat(np.cumsum(many) - many, sizes)
            group = _with_ends(np.where(ids >= 0, of[np.maximum(ids, 0)], k), sizes, k + 1)
            at = np.flatnonzero(ids < 0)
            place = at + np.repeat(np.arange(len(sizes)), sizes)[at] + 1
            code = (base[at] - ids[at] - 1) * (k + 2) ** 2 + group[place - 1] * (k + 2) + group[place + 1]
            code, n = np.unique(code, return_counts=True)
            word = words.take(pa.array(code // (k + 2) ** 2))
            yield pa.RecordBatch.from_arrays([word, pa.array((code % (k + 2) ** 2).astype("i4")), pa.array(n)], ["word", "pair", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, size = np.log(joint + 0.5), np.log(joint.sum(axis=1)[:k] + 0.5 * (k + 2))
        gain = log[:, None, :k] + log[:k].T[None] - 2 * size
        gain = np.concatenate([gain.reshape(-1, k), np.zeros((1, k))])
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                part = batch.slice(i, 20_000)
                lists = part.column("pairs")
                many = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                pair, n = flat.field("pair").to_numpy(), flat.field("n").to_numpy()
                sums = np.zeros((len(many), k))
                some = np.flatnonzero(many)
                if len(some):
                    starts = np.cumsum(many[some]) - many[some]
                    sums[some] = np.add.reduceat(gain[pair] * n[:, None], starts)
                group = pa.array(sums.argmax(axis=1).astype("i4"))
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n_train"), group], ["word", "n_train", "group"])

    seen = encoded.where("NOT _held AND size(rare) > 0").select("ids", "rare").mapInArrow(contexts, "word string, pair int, n bigint")
    pairs = seen.groupBy("word", "pair").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("word").agg(F.collect_list(F.struct("pair", "n")).alias("pairs"))
    # words that only held-out texts have are unseen: they need no class
    grouped = pairs.join(counts.select("word", "n_train"), "word").select("word", "n_train", "pairs")
    return saved(grouped.mapInArrow(choose, "word string, n_train bigint, group int"), "rare")


def _with_rare(encoded: DataFrame, rare: DataFrame) -> DataFrame:
    """``encoded`` with ``found``: for each rare word of the row that training has, its place, count and class."""
    uses = encoded.select("_row", F.posexplode("rare").alias("place", "word"))
    met = uses.join(rare, "word").groupBy("_row").agg(F.collect_list(F.struct("place", "n_train", "group")).alias("found"))
    out = encoded.select("_row", "_key", "_held", "ids").join(met, "_row", "left").select("_key", "_held", "ids", "found")
    return saved(out, "placed")


def _trigrams(encoded: DataFrame, shared, k: int) -> np.ndarray:
    """Counts of class triples over the training rows."""
    width = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width**3, np.int64)
        for batch in batches:
            group, n, sizes = _classes_and_counts(batch, *shared.value)
            h2, h1, c, _, _ = _histories(group, n > 0, sizes, k)
            sums += np.bincount((h2 * width + h1) * width + c, minlength=width**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    out = np.zeros(width**3, np.int64)
    for r in encoded.where("NOT _held").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out.reshape(width, width, width)
