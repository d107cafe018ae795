"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A segmentation of a text is a path through the lattice of vocabulary pieces. Its probability is the product of piece
probabilities. A vocabulary of merges has ranks instead of probabilities, so a piece gets one by Zipf's law of its rank;
``sharpness`` raises them to a power (0: all pieces alike; large: close to the best path). The forward pass adds up the
probabilities of all paths to each place, the backward pass draws a path from the end, piece by piece, in proportion.

In this vocabulary the mark for a space stands only at the front of a piece (or in runs of marks), so no piece
crosses from another character to a mark, and the lattice of a text is a row of small lattices, one for each *unit* of
marks and the characters after them. Each distinct unit is filtered once; drawing is done for all units of a batch at
once. The draw at a place is a hash of the seed, the row's key and the place, so it does not depend on
partitions or batches.

Characters without a piece become their bytes, and so does a space mark that the text itself contains; so decoding gives
the text back exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: A unit: spaces and what follows them. A line feed and a mark in the text are units of their own.
UNITS = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}")
#: Ids from here on stand for a character, by its number, until they are written as bytes.
CHARACTER = 1 << 24


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.held, self.filled = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.filled + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.empty(max(end, len(self.held)), self.held.dtype)])
        self.held[self.filled : end] = values
        self.filled = end

    def view(self) -> np.ndarray:
        return self.held[: self.filled]


class Lattices:
    """The vocabulary, and the filtered lattices of the units met so far."""

    def __init__(self, model_path: str, sharpness: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.pieces = {i: sp.id_to_piece(i) for i in normal}
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        weights = 1 / (1.0 + np.arange(len(order))) ** sharpness
        weights /= weights.sum()
        self.longest = max(map(len, self.pieces.values()))
        # a trie of the pieces: the steps (node, character) in order, where they lead, and what ends there
        prefixes = {"": 0}
        for piece in self.pieces.values():
            for n in range(1, len(piece) + 1):
                prefixes.setdefault(piece[:n], len(prefixes))
        steps = sorted((prefixes[p[:-1]] << 21 | ord(p[-1]), to) for p, to in prefixes.items() if p)
        self.steps, self.targets = (np.array(x) for x in zip(*steps))
        self.ids_of, self.weights_of = np.full(len(prefixes), -1), np.zeros(len(prefixes))
        for i, w in zip(order, weights.tolist()):
            self.ids_of[prefixes[self.pieces[i]]], self.weights_of[prefixes[self.pieces[i]]] = i, w
        #: A character as bytes is less likely than any piece.
        self.rare = float(weights.min()) / 10
        self.units: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.units.clear()
        self.first, self.sizes = Grown(np.int64), Grown(np.int64)  # of each unit: its first node, its characters
        self.ends = Grown(np.int64)  # of each node: where its edges end
        self.back, self.ids = Grown(np.int32), Grown(np.int32)  # of each edge: its characters and id
        self.bounds = Grown(np.float64)  # of each edge: its node plus where its share ends

    def numbers(self, units: list[str], most: int = 8_000_000) -> np.ndarray:
        """The number of each unit's lattice. Starts anew when it holds too many edges."""
        if self.back.filled > most:
            self._reset()
        known = self.units
        new = [u for u in dict.fromkeys(units) if u not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._add(new)
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _edges(self, chars: np.ndarray, stop: np.ndarray, literal: np.ndarray):
        """All pieces in the lattices: first character, length, id and weight. All places walk the trie together."""
        at, state = np.flatnonzero(~literal), None
        found = []
        lone = np.ones(len(chars), bool)
        for n in range(1, self.longest + 1):
            step = (0 if state is None else state << 21) | chars[at + n - 1]
            hit = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            ok = self.steps[hit] == step
            at, state = at[ok], self.targets[hit[ok]]
            whole = self.ids_of[state] >= 0
            found.append((at[whole], np.full(int(whole.sum()), n), self.ids_of[state[whole]], self.weights_of[state[whole]]))
            if n == 1:
                lone[at[whole]] = False
            more = at + n < stop[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        alone = np.flatnonzero(lone)
        found.append((alone, np.ones(len(alone), int), CHARACTER + chars[alone], np.full(len(alone), self.rare)))
        return [np.concatenate(x) for x in zip(*found)]

    def _add(self, units: list[str]) -> None:
        """Forward filtering of units; a unit's nodes are the places after each of its characters."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        literal = chars == ord(MARK)
        chars = np.where(chars == ord(" "), ord(MARK), chars)
        stop = np.repeat(first + sizes, sizes)
        place = np.arange(len(chars)) - np.repeat(first, sizes)
        start, length, ids, weight = self._edges(chars, stop, literal)
        node = start + length - 1
        order = np.lexsort((length, node))
        start, length, ids, weight, node = (x[order] for x in (start, length, ids, weight, node))
        share = np.empty(len(start))
        alpha = np.zeros(len(chars))
        # nodes at one distance from their unit's front are filtered together
        by_place = np.argsort(place[node], kind="stable")
        cuts = np.searchsorted(place[node][by_place], np.arange(int(sizes.max()) + 1))
        by_size = np.argsort(-sizes, kind="stable")
        for p in range(len(cuts) - 1):
            e = by_place[cuts[p] : cuts[p + 1]]
            came, to = start[e], node[e]
            part = np.where(place[came] == 0, 1.0, alpha[came - 1]) * weight[e] if p < self.longest else alpha[came - 1] * weight[e]
            begin = np.flatnonzero(np.diff(to, prepend=-1))
            total = np.add.reduceat(part, begin)
            alpha[to[begin]] = total
            share[e] = part / np.repeat(total, np.diff(begin, append=len(e)))
            if p >= self.longest and p % self.longest == 0:
                # only ratios into one node matter, so long units are scaled as they go
                long = first[by_size[: np.searchsorted(-sizes[by_size], -p, "left")]]
                scale = 1 / alpha[long + p]
                for back in range(self.longest):
                    alpha[long + p - back] *= scale
        ends = np.searchsorted(node, np.arange(len(chars)), "right")
        sums = np.cumsum(share)
        before = np.concatenate(([0.0], sums))[np.concatenate(([0], ends[:-1]))]
        nodes = self.ends.filled + node
        bounds = nodes + sums - before[node]
        bounds[ends - 1] = self.ends.filled + np.arange(len(chars)) + 1.0
        self.first.extend(self.ends.filled + first)
        self.sizes.extend(sizes)
        self.ends.extend(self.back.filled + ends)
        self.back.extend(length)
        self.ids.extend(ids)
        self.bounds.extend(bounds)


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit seeds and places, by a mixing function."""
    with np.errstate(over="ignore"):
        z = seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


@lru_cache
def lattices(model_path: str, sharpness: float) -> Lattices:
    return Lattices(model_path, sharpness)


def sample(texts: list[str], keys: list, model_path: str, sharpness: float, seed: int) -> list[np.ndarray]:
    """The drawn ids of each text."""
    lat = lattices(model_path, sharpness)
    bags = [UNITS.findall(" " + t) for t in texts]
    numbers = lat.numbers([u for bag in bags for u in bag])
    first, sizes, ends, back, ids, bounds = (
        x.view() for x in (lat.first, lat.sizes, lat.ends, lat.back, lat.ids, lat.bounds)
    )
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    size = sizes[numbers]
    begin = np.cumsum(size) - size  # units cover the texts without gaps
    row = np.repeat(np.arange(len(texts)), [len(b) for b in bags])
    seeds = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], np.uint64)
    drawn = np.full(int(lengths.sum()), -1, np.int64)
    unit, left = np.arange(len(numbers)), size.copy()
    base, own, origin = first[numbers], seeds[row], starts[row]
    while len(unit):
        node = base[unit] + left - 1
        u = draws(own[unit], begin[unit] + left - origin[unit])
        edge = np.searchsorted(bounds, node + u, "right")
        edge = np.minimum(edge, ends[node] - 1)
        left = left - back[edge]
        drawn[begin[unit] + left] = ids[edge]
        going = left > 0
        unit, left = unit[going], left[going]
    out = []
    for a, n in zip(starts.tolist(), lengths.tolist()):
        got = drawn[a : a + n]
        got = got[got >= 0]
        odd = np.flatnonzero(got >= CHARACTER)
        if len(odd):
            parts, done = [], 0
            for i in odd.tolist():
                raw = chr(int(got[i]) - CHARACTER).encode("utf-8", "surrogatepass")
                parts += [got[done:i], lat.bytes[list(raw)]]
                done = i + 1
            got = np.concatenate([*parts, got[done:]])
        out.append(got.astype("<i4"))
    return out


def decode(ids: np.ndarray, model_path: str, sharpness: float) -> str:
    """The text of a sequence of ids, without the space that encoding put in front."""
    table = _spelled(model_path, sharpness)
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


@lru_cache
def _spelled(model_path: str, sharpness: float) -> dict[int, bytes]:
    lat = lattices(model_path, sharpness)
    out = {i: p.replace(MARK, " ").encode() for i, p in lat.pieces.items()}
    return out | {int(i): bytes([b]) for b, i in enumerate(lat.bytes)}


def encode_sampled(
    docs: DataFrame,
    sharpness: float = 1.0,
    seed: int = 42,
    model_path: str | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``key, ids, n_pieces, ids_crc32, lossless``: a sampled segmentation of every text.

    ``ids`` are little-endian 32-bit numbers, ``lossless`` says whether decoding them gave the text back. Null texts
    count as empty; an empty text is the piece for the space that stands in front of every text. Rows with equal
    key and text get equal ids; a null key is a key of its own. A very long text is one lattice, held by its task. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    path = model_path or default_model()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            texts = batch.column("_text").to_pylist()
            drawn = sample(texts, batch.column(key).to_pylist(), path, sharpness, seed)
            bodies = [d.tobytes() for d in drawn]
            same = [decode(d, path, sharpness) == t for d, t in zip(drawn, texts)]
            columns = [pa.array(bodies, pa.binary()), pa.array([len(d) for d in drawn], pa.int64())]
            columns += [pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "ids", "n_pieces", "ids_crc32", "lossless"])

    read = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return read.mapInArrow(run, f"`{key}` {kind}, ids binary, n_pieces bigint, ids_crc32 bigint, lossless boolean")


def decode_ids(rows: DataFrame, sharpness: float = 1.0, model_path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids`` replaced by ``text``; null ids give null."""
    path = model_path or default_model()
    kept = [c for c in rows.columns if c not in (ids, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if b is None else decode(np.frombuffer(b, "<i4"), path, sharpness) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.select(*kept, ids).mapInArrow(run, f"{schema + ', ' if schema else ''}text string")
