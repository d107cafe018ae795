"""Token counts of fields and sections, from whole documents encoded once.

Encoding sections one by one gives other tokens than encoding the document, because tokens join characters
across section boundaries. Here each document is encoded once, every token keeps the span of characters that it
has bytes of, and spans are joined with the sections as intervals. A token across a boundary goes
where an explicit rule says:

* ``first``: to the section of its first character;
* ``last``: to the section of its last character;
* ``most``: to the section of its middle character, so across one boundary to the side with more characters,
  the earlier one if equal;
* ``share``: to every section in proportion to its characters.

The first three give whole numbers that add up to the document's tokens wherever sections cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .encoding import default_ranks, token_spans

RULES = ("first", "last", "most", "share")


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section ``[start, end)``. Sections may leave gaps or overlap; each is counted by itself."""
    first, after = spans[:, 0], spans[:, 1]
    if rule == "share":
        whole = np.maximum(after - first, 1)
        order = np.concatenate(([0], np.cumsum(np.ones(len(first)))))

        def before(x: np.ndarray) -> np.ndarray:
            done = np.searchsorted(after, x, "right")  # tokens that end by x
            begun = np.searchsorted(first, x, "left")  # tokens that start before x
            out = order[done]
            for i in np.flatnonzero(begun > done):
                t = slice(done[i], begun[i])
                out[i] += ((x[i] - first[t]) / whole[t]).sum()
            return out

        return before(ends) - before(starts)
    at = {"first": first, "last": after - 1, "most": first + (after - first - 1) // 2}[rule]
    return (np.searchsorted(at, ends, "left") - np.searchsorted(at, starts, "left")).astype(float)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines, each with the line feed that ends it; an empty text is one empty section."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    sizes[-1] -= 1
    if len(sizes) > 1 and not sizes[-1]:
        sizes = sizes[:-1]
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def line_tokens(
    docs: DataFrame, rule: str = "first", ranks_path: str | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, section, start, end, tokens, crossing``: one row per line of every document.

    ``start`` and ``end`` are in characters, ``tokens`` is what the rule gives the line, ``crossing`` counts the
    tokens that reach over the line's end. Null and empty texts are one empty section without tokens. Null
    and repeated keys are kept as they are. A very long text is encoded by one task. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    return _attribute(docs, None, rule, ranks_path, text, key)


def section_tokens(
    docs: DataFrame,
    sections: str,
    rule: str = "first",
    ranks_path: str | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """As ``line_tokens``, for sections given by the column ``sections``: an array of structs whose first two fields are
    the section's start and the character after its end. A null or empty array gives no row."""
    return _attribute(docs, sections, rule, ranks_path, text, key)


def field_tokens(
    rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", ranks_path: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """As ``line_tokens``, for the document made of ``fields`` in that order, joined by ``separator``; null fields are
    empty. A field's section holds the separator that follows it."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(separator)) for p in parts[:-1]] + parts[-1:]
    ends, spans = F.lit(0), []
    for part in parts:
        starts, ends = ends, ends + F.length(part)
        spans.append(F.struct(starts.alias("start"), ends.alias("end")))
    made = rows.select(F.col(key).alias("_key"), F.concat(*parts).alias("_document"), F.array(*spans).alias("_spans"))
    return section_tokens(made, "_spans", rule, ranks_path, "_document", "_key").withColumnRenamed("_key", key)


def _attribute(docs, sections, rule, ranks_path, text, key) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    path = ranks_path or default_ranks()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            rows, numbers, starts, ends, tokens, crossing = [], [], [], [], [], []
            given = batch.column("_sections").to_pylist() if sections else None
            for row, value in enumerate(batch.column("_text").to_pylist()):
                if given is None:
                    a, b = line_sections(value)
                elif given[row]:
                    pairs = [list(s.values())[:2] for s in given[row]]
                    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
                else:
                    continue
                spans = token_spans(value, path)
                rows.append(np.full(len(a), row))
                numbers.append(np.arange(len(a)))
                starts.append(a)
                ends.append(b)
                tokens.append(allocate(spans, a, b, rule))
                over = np.searchsorted(spans[:, 0], b, "left") - np.searchsorted(spans[:, 1], b, "right")
                crossing.append(np.maximum(over, 0))
            if not rows:
                continue
            flat = [np.concatenate(x) for x in (numbers, starts, ends, tokens, crossing)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(np.concatenate(rows))), *(pa.array(x).cast(t) for x, t in zip(flat, types))],
                [key, "section", "start", "end", "tokens", "crossing"],
            )

    read = docs.select(
        key, F.coalesce(F.col(text), F.lit("")).alias("_text"), *([F.col(sections).alias("_sections")] if sections else [])
    )
    out = read.mapInArrow(
        run, f"`{key}` {kind}, section int, start bigint, end bigint, tokens double, crossing bigint"
    )
    return out if rule == "share" else out.withColumn("tokens", F.col("tokens").cast("bigint"))
