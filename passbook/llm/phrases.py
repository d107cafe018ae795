"""Frequent phrases and how firmly their words belong together.

Every run of words has a Rabin-Karp fingerprint: prefix polynomials over word hashes, in arithmetic modulo 2 ** 64, from
which the hash of any run is a difference times a power. A word's hash is made the same way from its bytes. All of it is
numpy over whole slices of text.

Fingerprints are counted by a shuffle, level by level. A phrase can only be frequent where its parts are, so two words
are counted where both are frequent, and three or four where all their pairs are. A level learns this from a bit map of
the last one's frequent fingerprints, whose size is bounded; a wrongly set bit costs a row, never a result.

Fingerprints may collide, so the last reading counts texts. In a slice all runs of one fingerprint are compared, word by
word, with the first of them; only that one is turned into text, with a pointer to where it lies. Counts of frequent
fingerprints are then added up by phrase, so phrases that share a fingerprint come apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_text, join_groups, saved, slices

#: 0: part of a word, 1: blank, 2: end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\v\f\r")] = 2
#: Text of a slice; bytes hashed at a time (longer words are hashed as a whole).
SLICE, BLOCK = 8 << 20, 1 << 19
#: Words compared byte by byte at a time.
COMPARED = 1 << 16
#: Bits of a map for each fingerprint in it, and its greatest size (16 MB).
BITS_EACH, MAP_BITS = 32, 27
#: A bit map is gathered in pieces of so many bits.
PIECE = 32768
WORD_BASE, PHRASE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
BYTE_HASH = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
SCALE = 2_000_000


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))), dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2 ** 64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits, one to one."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xE9846AF9B1A615D)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


WORD_POWERS, WORD_INVERSES = powers(WORD_BASE, BLOCK), powers(inverse(WORD_BASE), BLOCK)


class Words:
    """The words of texts put one after the other: ``start``, ``end`` (bytes), ``piece`` and ``hash`` of each."""

    def __init__(self, data: bytes):
        self.data = data.lower()  # on bytes: A-Z only
        self.bytes = np.frombuffer(self.data, np.uint8)
        kinds = KIND[self.bytes]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), self.start)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            low = self.start[i]
            j = int(np.searchsorted(self.end, low + BLOCK, side="right"))
            if j <= i:
                out[i] = xxhash.xxh64_intdigest(self.data[low : self.end[i]], 42)
                i += 1
                continue
            a, b = self.start[i:j] - low, self.end[i:j] - low
            terms = BYTE_HASH[self.bytes[low : self.end[j - 1]]] * WORD_POWERS[: b[-1]]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
            out[i:j] = mixed((sums[b] - sums[a]) * WORD_INVERSES[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def identities(self) -> np.ndarray:
        """A number for each word, the same for equal words only: hashes whose words differ are told apart."""
        _, first, ids = np.unique(self.hash, return_index=True, return_inverse=True)
        length = self.end - self.start
        same = length == length[first][ids]
        for i in range(0, len(self), COMPARED):
            part = np.flatnonzero(same[i : i + COMPARED]) + i
            n = length[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here = self.bytes[np.repeat(self.start[part], n) + step]
            there = self.bytes[np.repeat(self.start[first[ids[part]]], n) + step]
            same[part[np.repeat(np.arange(len(part)), n)[here != there]]] = False
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            word = self.data[self.start[i] : self.end[i]]
            ids[i] = known.setdefault(word, len(first) + len(known))
        return ids

    def runs(self, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first word and fingerprint of every run of ``n`` words inside a piece. ``bits`` below 64 makes
        collisions, for tests."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.hash * powers(PHRASE_BASE, len(self) - 1), dtype=np.uint64)))
        back = powers(inverse(PHRASE_BASE), len(self) - n)
        prints = mixed((sums[n:] - sums[:-n]) * back + np.uint64(n))
        at = np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self) - n + 1])
        return at, prints[at] >> np.uint64(64 - bits)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]] for i in range(at, at + n))


class BitMap:
    """A set of fingerprints with two bits for each: never forgets one, may take others for members."""

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    def holds(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for at in (prints >> np.uint64(64 - self.size), prints & np.uint64((1 << self.size) - 1)):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def bit_map(prints: DataFrame) -> BitMap:
    """The map of a table's ``print`` column. Its bits are set by the executors; the driver receives the finished pieces,
    which are 2 ** ``MAP_BITS`` bits in all at most."""
    size = min(max((BITS_EACH * max(prints.count(), 1)).bit_length(), 16), MAP_BITS)
    high, low = F.shiftrightunsigned("print", 64 - size), F.col("print").bitwiseAND((1 << size) - 1)
    set_bits = prints.select(F.explode(F.array(high, low)).alias("at"))
    pieces = set_bits.groupBy(F.shiftright("at", 15).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(PIECE - 1)).alias("bits")
    )
    bits = np.zeros((1 << size) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        bits[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(r.bits, np.uint8)
    return BitMap(size, bits)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, Words]]:
    """Slices of one language with their words. A text ends its last piece."""
    for part in slices(batches, "_text", SLICE):
        codes = part.column("_lang").dictionary_encode()
        for code, name in enumerate(codes.dictionary.to_pylist()):
            mine = part.filter(pa.array(codes.indices.to_numpy() == code))
            yield name, mine, Words(b"\n".join(mine.column("_text").to_pylist()))


def _allowed(words: Words, at: np.ndarray, n: int, parts: int, known: BitMap, bits: int) -> np.ndarray:
    """Which of the runs of ``n`` words have all their runs of ``parts`` words in ``known``."""
    held = np.zeros(len(words), bool)
    where, prints = words.runs(parts, bits)
    held[where[known.holds(prints)]] = True
    out = np.ones(len(at), bool)
    for k in range(n - parts + 1):
        out &= held[at + k]
    return out


def _counts(texts: DataFrame, sizes: Sequence[int], parts: int, known, bits: int) -> DataFrame:
    """``lang, words, print, n``: fingerprints counted in each slice. ``words`` 0 has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, words in _by_language(batches):
            for n in sizes:
                at, prints = words.runs(n, bits)
                if known is not None:
                    prints = prints[_allowed(words, at, n, parts, known.value, bits)]
                found, counts = np.unique(prints, return_counts=True)
                size = np.full(len(found), n, np.int32)
                if n == 1:
                    found, counts = np.append(found, np.uint64(0)), np.append(counts, len(words))
                    size = np.append(size, np.int32(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array(size),
                        pa.array(found.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "words", "print", "n"],
                )

    found = texts.select("_lang", "_text").mapInArrow(run, "lang string, words int, print bigint, n bigint")
    return found.groupBy("lang", "words", "print").agg(F.sum("n").alias("n"))


def verified(words: Words, ids: np.ndarray, at: np.ndarray, prints: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Each different phrase among the runs ``at``: place of its first occurrence, and how many there are. Runs of one
    fingerprint are compared with the first of them, word by word; those that differ from it are told apart by their
    words."""
    _, first, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first][which]
    same = np.ones(len(at), bool)
    for k in range(n):
        same &= ids[at + k] == ids[lead + k]
    odd: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(~same).tolist():
        counts[which[i]] -= 1
        odd.setdefault(tuple(ids[at[i] : at[i] + n].tolist()), []).append(int(at[i]))
    out = list(zip(at[first].tolist(), counts.tolist()))
    return out + [(places[0], len(places)) for places in odd.values()]


def _texts(texts: DataFrame, longest: int, known, key: str, bits: int) -> DataFrame:
    """``lang, words, phrase, n, pointer``: texts of the runs whose fingerprints are in ``known``, counted in each
    slice; ``pointer`` is the row's key and the byte where the first occurrence starts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows, words in _by_language(batches):
            ids = words.identities()
            sizes = pc.binary_length(rows.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(sizes + 1) - sizes - 1
            for n in range(1, longest + 1):
                at, prints = words.runs(n, bits)
                keep = known[n].value.holds(prints)
                if n > 1:
                    keep &= _allowed(words, at, n, n - 1, known[n - 1].value, bits)
                found = verified(words, ids, at[keep], prints[keep], n)
                places = words.start[[p for p, _ in found]] if found else np.zeros(0, np.int64)
                row = np.searchsorted(begin, places, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([words.phrase(p, n).decode("utf-8", "replace") for p, _ in found], pa.string()),
                        pa.array([c for _, c in found], pa.int64()),
                        rows.column(key).take(pa.array(row)),
                        pa.array(places - begin[row]),
                        pa.array(np.full(len(found), n, np.int32)),
                    ],
                    ["lang", "phrase", "n", "_key", "_byte", "words"],
                )

    return texts.mapInArrow(run, f"lang string, phrase string, n bigint, _key {kind}, _byte bigint, words int")


def frequent_phrases(
    docs: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang", key: str = "doc_id", bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, n, some_key, some_byte`` of all phrases of 1 to ``longest`` words that occur at least
    ``least`` times in a language, and ``lang, n``: how many words a language has.

    Texts are split at ``.,;:!?`` and line ends into pieces, pieces at blanks and tabs into words, A-Z lowered. A phrase lies
    in one piece; overlapping occurrences all count. ``some_key`` and ``some_byte`` point to an occurrence, which
    may be another one in another run.
    """
    texts = docs.select(key, F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), binary_text(text).alias("_text"))
    context = docs.sparkSession.sparkContext
    levels, known, maps = [(1,), (2,), tuple(range(3, longest + 1))], None, {}
    totals = None
    for level, sizes in enumerate(levels):
        if not sizes:
            continue
        counted = _counts(texts, sizes, level, known, bits)
        often = saved(counted.where((F.col("n") >= least) | (F.col("words") == 0)), "fingerprints")
        if level == 0:
            totals, often = often.where("words = 0").select("lang", "n"), often.where("words > 0")
        for n in sizes:
            known = context.broadcast(bit_map(often.where(F.col("words") == n)))
            maps[n] = known
    found = _texts(texts, longest, maps, key, bits)
    pointer = (F.first("_key").alias("some_key"), F.first("_byte").alias("some_byte"))
    summed = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"), *pointer)
    return saved(summed.where(F.col("n") >= least), "phrases"), totals


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    longest: int = 4,
    least: int = 30,
    top: int = 2000,
    covered: tuple[int, int] = (80, 100),
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    bits: int = 64,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, some_key, some_byte``: each language's ``top`` phrases of 2 to
    ``longest`` words.

    ``a`` is how often the phrase occurs (at least ``least`` times), ``n`` how many words the language has. Cut in two after
    a word, its parts occur ``l`` and ``r`` times and the score is floor(2000000 a / (l + r)); the cut with the lowest
    score counts, ties to the earliest. A phrase that lies inside a longer one with f(longer) / a of at least ``covered``
    (as a fraction) is dropped, whether or not that one is. Order: score, then ``a``, both falling, then the phrase by its
    bytes. Products are decimals of 38 digits.

    Null texts count as empty, the null language is ``und``, keys may be null or repeated. A very long text is one slice:
    arrays of its words, some 60 bytes for each, are held by one task. Repeated rows count each. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    found, totals = frequent_phrases(docs, longest, least, text, lang, key, bits)
    phrases = found.where("words > 1").withColumn("_words", F.split("phrase", " "))
    # what a longer phrase covers
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " ")
            ),
        )
    )
    inner = phrases.where("words > 2").select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    left = phrases.join(inner, ["lang", "phrase"], "left")
    hidden = _exact("_longer") * covered[1] >= _exact("n") * covered[0]
    left = left.where(~F.coalesce(hidden, F.lit(False))).drop("_longer")
    left = saved(left.withColumnRenamed("n", "a"), "candidates")
    # both parts of every cut; the commonest first words are in many cuts
    sides = F.array(
        *[F.struct(F.lit(s).alias("left"), F.array_join(p, " ").alias("part")) for s, p in (
            (True, F.slice("_words", F.lit(1), F.col("k"))), (False, F.slice("_words", F.col("k") + 1, F.col("words"))),
        )]
    )
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = saved(cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*"), "cuts")
    asked = cuts.groupBy("lang", "part").agg(F.count("*").alias("_cuts"))
    known = asked.join(found.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    both = join_groups(cuts, known, ["lang", "part"], "_cuts", max(cuts.count(), 1))
    halves = both.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("n"))).alias("r")
    )
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = halves.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pointers = found.select("lang", "phrase", "some_key", "some_byte")
    # as many rows as languages, one a language
    named = ranked.join(totals, "lang").join(pointers, ["lang", "phrase"])
    return named.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "some_key", "some_byte")
