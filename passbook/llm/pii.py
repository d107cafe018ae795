"""Personal data by weak supervision.

Strict patterns find the base spans. Looser patterns propose candidates (written-out e-mail addresses, numbers
without a country prefix, card numbers and addresses that a strict rule refuses). Labelers of three sorts vote on
every span: regular expressions with their checks, gazetteers, and the words around it. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is for each kind, and with that how likely each
pattern is personal data. A logistic classifier on span features is trained on those likelihoods. It decides about
the candidates; base spans always stay.

Votes and features are small codes, so what is gathered from the corpus is a table of counts whose size is
bounded by the codes, not by the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9][0-9.\x20()-]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser proposals.
WRITTEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?"
    r"[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}+"
)
NUMBER = re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?(?<![0-9])[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
LONG_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])")

#: Gazetteers: top-level domains in common use, leading digits of card issuers, words that announce personal data.
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ca it nl ch at".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "6011", "65", "62", "50")
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "anruf", "appel", "llame"),
}
#: Words before numbers that are something else.
OTHER = ("isbn", "issn", "version", "order", "invoice", "serial", "item", "no.", "page", "doi", "v.")
#: Characters before a span that are searched for such words.
WINDOW = 40
LABELERS = ("format", "check", "gazetteer", "cue", "other", "joined")
#: What is taken of each labeler before any vote is seen, as P(abstains, for, against) for spans that are not personal
#: data and for spans that are; worth ``PRIOR_VOTES`` votes.
PRIORS = np.array(
    [
        [[0.0, 0.1, 0.9], [0.0, 0.8, 0.2]],
        [[0.0, 0.1, 0.9], [0.0, 0.98, 0.02]],
        [[0.0, 0.3, 0.7], [0.0, 0.9, 0.1]],
        [[0.95, 0.05, 0.0], [0.6, 0.4, 0.0]],
        [[0.6, 0.0, 0.4], [0.98, 0.0, 0.02]],
        [[0.5, 0.0, 0.5], [0.97, 0.0, 0.03]],
    ]
)
PRIOR_VOTES = 50
#: What all spans of a kind weigh together, at every size: the model follows from the proportions of their patterns, and
#: the priors have their weight in the same unit.
BASIS = 1000
FEATURES = ("format", "valid", "listed", "cue", "other", "joined", "separated", "base")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind number, start, end`` of the strict patterns, leftmost and without overlap in each kind. Linear time."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    ips, cards = [], []
    for cluster in DIGITS.finditer(text):
        a, b = cluster.span()
        if b - a < 7:
            continue
        ips += [(1, *m.span()) for m in IP.finditer(text, a, b) if _ip_ok(m.group())]
        if b - a >= 16:
            for m in CARD.finditer(text, a, b):
                if m.end() - m.start() >= 16:
                    digits = _only_digits(m.group())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        cards.append((2, *m.span()))
    phones = [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out + ips + cards + phones


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that overlap no base span and no earlier proposal."""
    found = []
    if "dot" in text:
        found += [(0, *m.span()) for m in WRITTEN.finditer(text)]
    for cluster in DIGITS.finditer(text):
        a, b = cluster.span()
        if b - a < 7:
            continue
        found += [(1, *m.span()) for m in IP.finditer(text, a, b)]
        if b - a >= 12:
            found += [(3, *m.span()) for m in NUMBER.finditer(text, max(0, a - 2), b)]
        if b - a >= 13:
            found += [(2, *m.span()) for m in LONG_NUMBER.finditer(text, a, b)]
    # one pass over both lists by start: ``reach`` is how far the spans that have begun go
    taken = sorted((s, e) for _, s, e in base)
    out, at, reach = [], 0, 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], x[0], x[2])):
        while at < len(taken) and taken[at][0] <= start:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start and (at == len(taken) or end <= taken[at][0]):
            out.append((kind, start, end))
            reach = end
    return out


def describe(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int]:
    """Codes of a span's votes (base 3: 0 abstains, 1 for, 2 against) and of its features (one bit each)."""
    span, name = text[start:end], KINDS[kind]
    before = text[max(0, start - WINDOW) : start].lower()
    digits = _only_digits(span) if len(span) < 200 else "0" * 99
    if kind == 0:
        formed, valid = "(at)" not in span and "[at]" not in span or "dot" in span, len(span) <= 254
        listed = re.split(r"[.\x20\[\](){}]+", span.rstrip(")]}").lower())[-1] in DOMAINS
    elif kind == 1:
        formed = not any(len(p) > 1 and p[0] == "0" for p in span.split("."))
        valid, listed = _ip_ok(span), not span.startswith(("0", "127.", "255."))
    elif kind == 2:
        groups = re.split(r"[\x20.-]", span)
        formed = len(groups) == 1 or all(len(g) >= 4 for g in groups)
        valid, listed = 13 <= len(digits) <= 19 and luhn(digits), digits.startswith(ISSUERS)
    else:
        formed, valid = "+" in span or "(" in span, 8 <= len(digits) <= 15
        listed = len(digits) >= 10 and digits[-10] not in "01"
    cue = any(w in before for w in CUES[name])
    other = any(w in before for w in OTHER)
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    votes = (
        1 if formed else 2,
        1 if valid else 2,
        1 if listed else 2,
        1 if cue else 0,
        2 if other else 0,
        2 if joined else 0,
    )
    code = 0
    for v in votes:
        code = code * 3 + v
    separated = kind in (2, 3) and any(c in span for c in " .-")
    bits = (formed, valid, listed, cue, other, joined, separated, base)
    return code, sum(1 << i for i, b in enumerate(bits) if b)


def _inputs(features: int) -> list[float]:
    """The classifier's inputs: all features but the last, which says that a span is a base span."""
    return [1.0, *(float(features >> i & 1) for i in range(len(FEATURES) - 1))]


@dataclass(frozen=True)
class SpanModel:
    """What the corpus taught: ``reliability[kind]`` has P(vote | personal or not) by labeler, ``weights[kind]`` the
    classifier, ``prior[kind]`` the share of proposals and of base spans that is personal data. Small and bounded."""

    reliability: np.ndarray = field(repr=False)
    prior: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    least: float = 0.9
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def accepts(self, kind: int, features: int) -> bool:
        """Whether the classifier takes spans with these features; worked out once for each of them."""
        code = (kind, features)
        if code not in self.known:
            self.known[code] = self.probability(kind, features) >= self.least
        return self.known[code]

    def probability(self, kind: int, features: int) -> float:
        return float(1 / (1 + np.exp(-np.array(_inputs(features)) @ self.weights[kind])))

    def spans(self, text: str) -> tuple[list, list]:
        """The base spans, and all spans, each by kind and start."""
        base = base_spans(text)
        more = [s for s in proposals(text, base) if self.accepts(s[0], describe(text, *s, False)[1])]
        return base, sorted(base + more)


def _votes(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def estimate(counts: list[tuple[int, int, int, int]], rounds: int = 100, least: float = 0.9) -> SpanModel:
    """Fit labeler reliabilities by expectation-maximisation and then the classifier, from rows of ``kind, votes,
    features, count``."""
    reliability = np.zeros((len(KINDS), len(LABELERS), 2, 3))
    prior, weights = np.full((len(KINDS), 2), 0.5), np.zeros((len(KINDS), len(FEATURES)))
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r[0] == kind]
        hot = np.eye(3)[np.array([_votes(r[1]) for r in rows], int).reshape(-1, len(LABELERS))]
        n = np.array([r[3] for r in rows], float)
        n *= BASIS / max(n.sum(), 1.0)
        strict = np.array([r[2] >> (len(FEATURES) - 1) & 1 for r in rows], int)
        pseudo = (PRIORS + 0.005) * PRIOR_VOTES
        table, p, post = pseudo / pseudo.sum(-1, keepdims=True), np.array([0.5, 0.9]), np.zeros(len(rows))
        for _ in range(rounds):
            both = np.einsum("rlv,lcv->rc", hot, np.log(table)) + np.log(np.stack([1 - p, p]))[:, strict].T
            post = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
            w = np.stack([n * (1 - post), n * post], axis=1)
            table = np.einsum("rc,rlv->lcv", w, hot) + pseudo
            table /= table.sum(-1, keepdims=True)
            for s in (0, 1):
                p[s] = (w[strict == s, 1].sum() + 10) / (n[strict == s].sum() + 20)
        reliability[kind], prior[kind] = table, p
        # every pattern of votes that can occur counts a little, so that the classifier also learns what the corpus lacks
        grid = np.array(list(product((1, 2), (1, 2), (1, 2), (0, 1), (0, 2), (0, 2), (0, 1))))
        each = np.einsum("rlv,lcv->rc", np.eye(3)[grid[:, :-1]], np.log(table)) + np.log([1 - p[0], p[0]])
        x = np.column_stack([np.ones(len(grid)), grid[:, :3] == 1, grid[:, 3:6] > 0, grid[:, 6]])
        seen = np.array([_inputs(r[2]) for r in rows]).reshape(-1, len(FEATURES))
        weights[kind] = _logistic(
            np.vstack([seen, x]), np.append(post, 1 / (1 + np.exp(each[:, 0] - each[:, 1]))), np.append(n, np.ones(len(grid)))
        )
    return SpanModel(reliability, prior, weights, least)


def _logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method on soft targets."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (target - p)) - ridge * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_span_model(docs: DataFrame, least: float = 0.9, text: str = "text") -> SpanModel:
    """Votes on every span of every document, counted by pattern; then ``estimate``. An empty table gives a model that
    adds nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for value in batch.column("_text").to_pylist():
                base = base_spans(value)
                for spans, strict in ((base, True), (proposals(value, base), False)):
                    for s in spans:
                        pattern = (s[0], *describe(value, *s, strict))
                        seen[pattern] = seen.get(pattern, 0) + 1
        columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "votes", "features", "n"])

    read = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counted = read.mapInArrow(count, "kind bigint, votes bigint, features bigint, n bigint")
    rows = counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "features")
    return estimate([tuple(r) for r in rows.collect()], least=least)


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_spans, spans``: one row per row of ``docs``.

    Counts are of base spans. Lists are ``kind:start:end`` by kind and start, joined by commas, in code points, ends
    exclusive. Null texts count as empty; null and repeated keys are kept as they are. Of proposals that overlap the first
    one counts, of those with one start the first kind. A very long text takes time in proportion to it. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            counts, strict, every = [], [], []
            for value in batch.column("_text").to_pylist():
                base, spans = model.spans(value)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                strict.append(listing(base))
                every.append(listing(spans))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            columns = [batch.column(key), *(pa.array(c) for c in n.T.copy()), pa.array(strict, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    read = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    numbers = ", ".join(f"n_{k} bigint" for k in KINDS)
    return read.mapInArrow(run, f"`{key}` {kind}, {numbers}, base_spans string, spans string")


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``; overlapping spans are
    replaced once, by the kind that begins first. Null texts stay null; all other columns are kept."""

    def clean(value: str | None) -> str | None:
        if value is None:
            return None
        parts, done = [], 0
        for kind, start, end in sorted(model.spans(value)[1], key=lambda s: (s[1], -s[2], s[0])):
            if end <= done:
                continue
            if start >= done:
                parts += [value[done:start], f"<{KINDS[kind].upper()}>"]
            done = end
        return "".join(parts) + value[done:] if parts else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = pa.array([clean(v) for v in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)

