"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a bag of windows of at most ``WIDTH`` characters: its words (long ones in overlapping windows), and runs of
single characters with the white space between them taken out. The kernel of two windows sums, over all
subsequences of 3 and 4 characters within a bounded span, the product of their decayed weights, so a word still
matches with characters put in, left out or replaced at some places. Characters are folded: A-Z are lowered, digits and
signs that stand for letters become them, other signs are passed over.

A machine is trained on windows, while labels belong to documents: a toxic document has at least one
toxic window, others have none. Training starts from the windows whose substrings are over-represented in toxic
documents and then alternates between fitting the machine and choosing each toxic document's best window, and
the clean documents' worst ones, again. The Nyström map sends a window to its kernels with the landmarks, times the
inverse root of the landmarks' own kernel matrix; a linear machine is fitted there. Since kernels are inner
products of weighted subsequences, the machine over all landmarks folds into one weight for each subsequence, and
scoring a window costs the same for any number of landmarks.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

WIDTH, STRIDE = 12, 6
SYMBOLS, SIGN, FRONT = 40, 39, 38
DECAY = 0.7
#: Subsequence lengths and the longest stretch that each may span.
SPANS = {3: 5, 4: 8}
#: Signs that are read as letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
APART = re.compile(r"(?<!\S)(?:\S[ \t-\r]){3,}\S(?!\S)")
#: Words whose margins a worker remembers, and text that it splits into words at a time.
REMEMBERED, SLICE = 250_000, 1 << 20
#: Windows whose subsequences the fit holds at a time.
FITTED = 64
#: Length of the substrings that training starts from, and how many are used at most.
GRAM, MOST_GRAMS = 5, 20_000
#: A word is trained on as toxic where its share of toxic documents is more than so many times that of clean ones.
COMMON = 4
#: Documents of a class that suffice to fit on.
ENOUGH = 200


def _symbols() -> np.ndarray:
    """The symbol of each character of the basic plane: 1-26 letters, 27-37 other letters by their number, 39 signs. 38 is
    the front of a word."""
    out = np.full(1 << 16, SIGN, np.uint8)
    for i in range(128, 1 << 16):
        if chr(i).isalpha():
            out[i] = 27 + ord(chr(i).lower()[0]) % 11
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    for sign, letter in STAND_INS.items():
        out[ord(sign)] = out[ord(letter)]
    return out


TABLE = _symbols()
TUPLES = {
    n: [c for c in combinations(range(WIDTH), n) if c[-1] - c[0] < reach] for n, reach in SPANS.items()
}


def words_of(text: str) -> list[str]:
    """Words without white space, then runs of single characters as one word each."""
    found = text.split()
    return found + ["".join(m.group().split()) for m in APART.finditer(text)]


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each window, and the number of the word that it is from. Every word has one window at least,
    one of signs alone an empty one."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = np.insert(TABLE[np.where(points < 1 << 16, points, 0)], np.cumsum(sizes) - sizes, FRONT)
    sizes = sizes + 1
    read = symbols != SIGN
    sizes = np.bincount(np.repeat(np.arange(len(words)), sizes), read, len(words)).astype(np.int64)
    symbols = np.append(symbols[read], np.zeros(WIDTH, np.uint8))
    many = 1 + np.maximum(0, -(-(sizes - WIDTH) // STRIDE))
    word = np.repeat(np.arange(len(words)), many)
    number = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    at = np.maximum(np.minimum(number * STRIDE, sizes[word] - WIDTH), 0)
    inside = at[:, None] + np.arange(WIDTH)
    out = symbols[(np.cumsum(sizes) - sizes)[word][:, None] + np.minimum(inside, sizes[word][:, None])]
    return np.where(inside < sizes[word][:, None], out, 0).astype(np.int64), word


def subsequences(window: np.ndarray) -> dict[int, dict[int, float]]:
    """For each length, the weight of every subsequence of one window: code -> sum of decays by span."""
    out: dict[int, dict[int, float]] = {}
    for n, tuples in TUPLES.items():
        got: dict[int, float] = {}
        for c in tuples:
            s = window[list(c)]
            if ((s == 0) | (s == SIGN)).any():
                continue
            code = 0
            for x in s:
                code = code * SYMBOLS + int(x)
            got[code] = got.get(code, 0.0) + DECAY ** (c[-1] - c[0] + 1 - n)
        out[n] = got
    return out


@dataclass(frozen=True)
class Machine:
    """A weight for every subsequence, a bias, and the slope and shift that turn the best margin into a probability."""

    weights: dict[int, np.ndarray]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, wins: np.ndarray) -> np.ndarray:
        out = np.full(len(wins), self.bias)
        for n, tuples in TUPLES.items():
            table = self.weights[n]
            powers = [np.ascontiguousarray(wins.T) * SYMBOLS**p for p in range(n - 1, -1, -1)]
            for c in tuples:
                code = powers[0][c[0]] + powers[1][c[1]]
                for p in range(2, n):
                    code += powers[p][c[p]]
                out += table[code] * DECAY ** (c[-1] - c[0] + 1 - n)
        return out

    def word_margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        out = np.full(len(words), -np.inf)
        for i in range(0, len(words), 20_000):
            wins, word = windows(words[i : i + 20_000])
            np.maximum.at(out, word + i, self.margins(wins))
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(
    positive: list[str], negative: list[str], landmarks: int = 256, strength: float = 1.0, counts: list[int] | None = None
) -> Machine:
    """Fit the machine on windows of words: Nyström features from landmarks of both classes, then a linear machine with
    squared hinge loss, classes weighted alike. ``positive`` and ``negative`` come with the most telling first; ``counts`` weighs the
    positive ones."""
    half = landmarks // 2
    chosen = positive[:half] + negative[:half]
    parts = [subsequences(w) for w in windows(chosen)[0]]
    index: dict[tuple[int, int], int] = {}
    rows, columns, values = [], [], []
    for i, part in enumerate(parts):
        norm = np.sqrt(sum(v * v for got in part.values() for v in got.values())) or 1.0
        for n, got in part.items():
            for code, v in got.items():
                rows.append(i)
                columns.append(index.setdefault((n, code), len(index)))
                values.append(v / norm)
    phi = np.zeros((len(parts), len(index)))
    phi[rows, columns] = values
    kernel = phi @ phi.T
    lam, vec = np.linalg.eigh(kernel)
    keep = lam > 1e-6 * max(lam.max(), 1e-12)
    root = vec[:, keep] / np.sqrt(lam[keep])
    # kernels of the training windows with the landmarks, by their shared subsequences
    wins, word = windows(positive + negative)
    places = {n: np.full(SYMBOLS**n, -1, np.int32) for n in SPANS}
    for (n, code), j in index.items():
        places[n][code] = j
    kernels = []
    for i in range(0, len(wins), FITTED):
        part = wins[i : i + FITTED]
        k = np.zeros((len(part), len(index)))
        for n, tuples in TUPLES.items():
            powers = [part.T * SYMBOLS**p for p in range(n - 1, -1, -1)]
            for c in tuples:
                j = places[n][sum(powers[p][c[p]] for p in range(n))]
                hit = np.flatnonzero(j >= 0)
                k[hit, j[hit]] += DECAY ** (c[-1] - c[0] + 1 - n)
        kernels.append(k @ phi.T)
    z = np.concatenate(kernels) @ root
    y = np.where(word < len(positive), 1.0, -1.0)
    # a long positive word has windows without the telling part: only its best window has to be positive
    weight = np.where(y > 0, np.append(counts or np.ones(len(positive)), np.ones(len(negative)))[word], 1.0)
    w, b = _machine(z, y, weight, strength)
    for _ in range(2):
        m = z @ w + b
        best = np.full(len(positive) + len(negative), -np.inf)
        np.maximum.at(best, word, m)
        use = (y < 0) | (m >= best[word])
        w, b = _machine(z[use], y[use], weight[use], strength)
    flat = phi.T @ (root @ w)
    tables = {n: np.zeros(SYMBOLS**n, np.float32) for n in SPANS}
    for (n, code), j in index.items():
        tables[n][code] = flat[j]
    return Machine(tables, float(b))


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton's method."""
    x = np.column_stack([z, np.ones(len(z))])
    both = [max(weight[y > 0].sum(), 1e-9), max(weight[y < 0].sum(), 1e-9)]
    share = weight * np.where(y > 0, 0.5 / both[0], 0.5 / both[1]) * len(y) * strength
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xo = x[on] * share[on, None]
        step = np.linalg.solve(xo.T @ x[on] + ridge, xo.T @ (y[on] * gap[on]) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], w[-1]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by penalised logistic regression; never a falling slope."""
    x = np.column_stack([margin, np.ones(len(margin))])
    w, ridge = np.array([1.0, 0.0]), np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def sample_labelled(
    docs: DataFrame, labels: DataFrame, most: int, label: str, text: str, key: str
) -> DataFrame:
    """``_y, _half, _text`` of at most ``most`` documents of each class, those with the smallest hash of their key. A
    document with several labels takes their rounded mean; null labels and keys do not count."""
    clean = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key)
    one = clean.agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    order = F.xxhash64(F.col(key).cast("string"))
    picks = [one.where(F.col("_y") == y).orderBy(order, key).limit(most) for y in (0, 1)]
    picked = picks[0].union(picks[1]).withColumn("_half", F.pmod(order, F.lit(2)))
    read = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return read.join(F.broadcast(picked), key).select("_y", "_half", "_text")


def train(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 4000,
    landmarks: int = 256,
    rounds: int = 3,
    label: str = "toxic",
    text: str = "text",
    key: str = "doc_id",
) -> Machine | None:
    """Train on at most ``most`` documents of each class. Half of them fit the machine, the other half the probability;
    all do both where a half of a class is less than ``ENOUGH``. None if a class has no document."""
    held = saved(sample_labelled(docs, labels, most, label, text, key), "labelled")
    n = {(r._half, r._y): r.n for r in held.groupBy("_half", "_y").agg(F.count("*").alias("n")).collect()}
    if not (n.get((0, 0)) or n.get((1, 0))) or not (n.get((0, 1)) or n.get((1, 1))):
        return None
    split = all(n.get((h, y), 0) >= ENOUGH for h in (0, 1) for y in (0, 1))
    fitting = held.where("_half = 0") if split else held
    grams = _telling_grams(fitting)
    machine = None
    negative: dict[str, float] = {}
    for _ in range(rounds):
        positive, times, worst = _pick(fitting, machine, grams)
        for word, margin in worst:
            negative[word] = margin
        if not positive:
            return None
        machine = fit(positive, sorted(negative, key=lambda w: (-negative[w], w)), landmarks, counts=times)
    rest = _best_margins(held.where("_half = 1") if split else held, machine)
    pairs = np.array([[r.margin, r.y, r.n] for r in rest.collect()], float)
    # equal margins are counted, and margins are rounded, so this is bounded
    slope, shift = _platt(np.repeat(pairs[:, 0], pairs[:, 2].astype(int)), np.repeat(pairs[:, 1], pairs[:, 2].astype(int)))
    return Machine(machine.weights, machine.bias, slope, shift)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the substrings of ``GRAM`` symbols, one row for each window's place; -1 where there is none."""
    wins, word = windows(words)
    code = np.zeros((len(wins), WIDTH - GRAM + 1), np.int64)
    bad = np.zeros_like(code, bool)
    for i in range(GRAM):
        part = wins[:, i : WIDTH - GRAM + 1 + i]
        code = code * SYMBOLS + part
        bad |= (part == 0) | (part == SIGN)
    return np.where(bad, -1, code), word


def _telling_grams(docs: DataFrame) -> dict[int, float]:
    """The substrings that occur in more toxic documents than chance explains, with their log-odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for y, value in zip(batch.column("_y").to_pylist(), batch.column("_text").to_pylist()):
                seen[y].update(np.unique(_grams(words_of(value) or ["."])[0]).tolist())
                seen[y][-2] += 1
        codes = sorted(set(seen[0]) | set(seen[1]))
        columns = [codes, [seen[1][c] for c in codes], [seen[0][c] for c in codes]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["code", "pos", "neg"])

    counted = docs.select("_y", "_text").mapInArrow(count, "code bigint, pos bigint, neg bigint")
    sums = saved(counted.groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "grams")
    total = sums.where("code = -2").first()
    lift = F.log((F.col("pos") + 0.5) / (total.pos + 1)) - F.log((F.col("neg") + 0.5) / (total.neg + 1))
    # in one toxic document of 200 at least, and five deviations over what all documents would give by chance
    chance = (F.col("pos") + F.col("neg")) * (total.pos / max(total.pos + total.neg, 1))
    rows = sums.where((F.col("code") >= 0) & (F.col("pos") >= max(3, total.pos // 200))).withColumn("lift", lift)
    telling = rows.where((F.col("lift") > 1.5) & (F.col("pos") - chance > 5 * F.sqrt(chance + 0.5)))
    return {r.code: r.lift for r in telling.orderBy(F.desc("lift"), "code").limit(MOST_GRAMS).select("code", "lift").collect()}


def _pieces(word: str) -> list[str]:
    """A word to train on, or of a very long one pieces of which each window is in one."""
    step = 3 * WIDTH
    return [word] if len(word) <= 4 * WIDTH else [word[i : i + 4 * WIDTH] for i in range(0, len(word) - WIDTH, step)]


def _pick(
    docs: DataFrame, machine: Machine | None, grams: dict[int, float], most: int = 3000
) -> tuple[list[str], list[int], list[tuple[str, float]]]:
    """Words to fit on: the best words of the toxic documents and in how many they are; of the clean ones the worst and
    some others."""
    known = np.array(sorted(grams), np.int64)
    lifts = np.array([grams[c] for c in sorted(grams)] + [0.0])

    def rate(words: list[str]) -> np.ndarray:
        if machine:
            return machine.word_margins(words)
        code, word = _grams(words)
        out = np.zeros(len(words))
        if len(known):
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            np.maximum.at(out, word, np.where(known[at] == code, lifts[at], 0.0).max(axis=1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = []
            for y, value in zip(batch.column("_y").to_pylist(), batch.column("_text").to_pylist()):
                words = list(dict.fromkeys(p for w in words_of(value.lower()) for p in _pieces(w)))
                if not words:
                    continue
                rates = rate(words)
                if y:
                    best = np.flatnonzero(rates >= max(rates.max() - 0.5, 1.5 if machine is None else 0.0))[:8]
                    got += [(1, words[i], float(rates[i])) for i in best]
                else:
                    got += [(0, words[i], float(rates[i])) for i in {int(np.argmax(rates)), *range(0, len(words), 50)}]
            columns = list(zip(*got)) or [[], [], []]
            types = (pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["y", "word", "rate"])

    found = docs.select("_y", "_text").mapInArrow(run, "y bigint, word string, rate double")
    words = saved(found.groupBy("y", "word").agg(F.max("rate").alias("rate"), F.count("*").alias("n")), "words")
    toxic = words.where("y = 1").orderBy(F.desc("n"), F.desc("rate"), "word").limit(most).collect()
    clean = words.where("y = 0")
    worst = clean.orderBy(F.desc("rate"), "word").limit(most // 2).collect()
    other = clean.orderBy(F.xxhash64("word"), "word").limit(most).collect()
    # a word that clean documents have about as often is not toxic; shares, so that it is the same at every size
    total = {r._y: r.n for r in docs.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = {r.word: r.n / total[0] for r in worst}
    positive = [r for r in toxic if COMMON * share.get(r.word, 0.0) < r.n / total[1]]
    if toxic and not positive:
        warnings.warn("no word is much commoner in toxic documents than in clean ones; all are trained on", stacklevel=2)
        positive = toxic
    return [r.word for r in positive], [r.n for r in positive], [(r.word, r.rate if machine else 0.0) for r in [*worst, *other]]


def _document_margins(machine: Machine, texts: list[str], known: dict[str, float]) -> np.ndarray:
    bags = [words_of(t) for t in texts]
    new = list({w for bag in bags for w in bag if w not in known})
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list({w for bag in bags for w in bag})
    known.update(zip(new, machine.word_margins(new).tolist()))
    return np.array([max([known[w] for w in bag], default=machine.bias) for bag in bags], float)


def _best_margins(docs: DataFrame, machine: Machine) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, "_text"):
            margins = _document_margins(shared.value, batch.column("_text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([pa.array(margins.round(2)), batch.column("_y").cast(pa.int64())], ["margin", "y"])

    return docs.select("_y", "_text").mapInArrow(run, "margin double, y bigint").groupBy("margin", "y").agg(F.count("*").alias("n"))


def score(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, the probability of being toxic) and ``predicted`` (1 from 0.5 on).

    Null texts count as empty. A text without a word has the margin of a window in which nothing matches.
    Without a machine, as no class or only one has labelled rows, every score is 0. A very long text
    counts by its worst word, all of it is read. An empty table gives an empty result. Columns of those names that ``docs`` had are replaced; all others are kept and not looked at.
    """
    plain = docs.drop("score", "predicted")
    if machine is None:
        return plain.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    # only texts go to Python and only scores come back: all other columns stay where they are
    @F.arrow_udf("double")
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for part in parts:
            got = np.zeros(0)
            for batch in slices([pa.RecordBatch.from_arrays([part], ["text"])], "text", SLICE):
                margins = _document_margins(shared.value, batch.column("text").to_pylist(), known)
                got = np.append(got, shared.value.probability(margins))
            yield pa.array(got)

    scored = plain.withColumn("score", probability(F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
