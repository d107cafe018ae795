"""Byte-level BPE encoding inside tasks, with a memory of the chunks a worker has met.

A text is cut into chunks of white space followed by other characters. The tokenizer's own word pattern never
joins characters across such a cut, so the ids of a text are the ids of its chunks, one after the other.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import tiktoken

#: The characters that the word pattern takes as white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The string that the tokenizer takes as one token wherever it stands, and the token's id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 800_000


def default_ranks() -> str:
    """The vocabulary of ``byte_bpe_50k.json`` as ranks; both files hold the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Chunks(dict):
    """chunk -> what ``make`` gives for it, for at most ``REMEMBERED`` chunks of bounded length."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        out = self.make(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


@lru_cache
def bpe(ranks_path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def _id_chunks(ranks_path: str) -> _Chunks:
    encode = bpe(ranks_path).encode_ordinary
    return _Chunks(lambda chunk: array("I", encode(chunk)).tobytes())


def encode_bytes(text: str, ranks_path: str) -> bytes:
    """The ids of ``text``, each as four little-endian bytes. The special string is one token, as in the tokenizer's file."""
    known = _id_chunks(ranks_path)
    if SPECIAL in text:
        mark = SPECIAL_ID.to_bytes(4, "little")
        return mark.join([b"".join([known[c] for c in CHUNKS.findall(part)]) for part in text.split(SPECIAL)])
    return b"".join([known[c] for c in CHUNKS.findall(text)])


@lru_cache
def _span_chunks(ranks_path: str) -> _Chunks:
    coder = bpe(ranks_path)

    sizes_of = [len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)]

    def spans(chunk: str) -> bytes:
        """For each token the first character that it has bytes of, and the one after the last."""
        sizes = [sizes_of[i] for i in coder.encode_ordinary(chunk)]
        ends = list(accumulate(sizes))
        if chunk.isascii():
            return array("i", [x for end, n in zip(ends, sizes) for x in (end - n, end)]).tobytes()
        owner = [i for i, c in enumerate(chunk) for _ in range(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff"))]
        return array("i", [x for end, n in zip(ends, sizes) for x in (owner[end - n], owner[end - 1] + 1)]).tobytes()

    return _Chunks(spans)


def token_spans(text: str, ranks_path: str) -> np.ndarray:
    """One row for each token of ``text``: the first character that it has bytes of, and the one after the last."""
    known = _span_chunks(ranks_path)
    chunks = CHUNKS.findall(text)
    parts = [known[c] for c in chunks]
    tokens = np.array([len(p) for p in parts], np.int64) >> 3
    sizes = np.array([len(c) for c in chunks], np.int64)
    shift = np.repeat(np.cumsum(sizes) - sizes, tokens)
    return np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2) + shift[:, None]
