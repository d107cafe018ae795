import random
import re
from collections import Counter

import numpy as np
import pytest

from passbook.llm import phrases
from passbook.llm.phrases import BLOCK, Words, collocations, frequent_phrases, verified

SCHEMA = "doc_id bigint, text string, lang string, phrase string, words int, n int, _lang string, _text string, score int"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def brute(rows, longest=4, least=3, top=2000, share=(80, 100)):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    often = {k: c for k, c in counts.items() if c >= least and len(k[1]) > 1}
    inside = Counter()
    for (lang, w), c in often.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[lang, w[i : i + n]] = max(inside[lang, w[i : i + n]], c)
    out = {}
    for (lang, w), a in often.items():
        if inside[lang, w] * share[1] >= a * share[0]:
            continue
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        row = (" ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], totals[lang], score)
        out.setdefault(lang, []).append(row)
    rows = set()
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows |= {(lang, i + 1, *r) for i, r in enumerate(found[:top])}
    return rows


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "éa", "ÀB", "x y", "the", "The"]
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; "]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice(signs) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(i, None, "en") for i in (0, 5)] + [(None, "the w1 the w1", "en"), (7, "", "de"), (7, " .\n", None)]
    rows += [(200, "of the same of the same " * 400, "en"), (200, "of the same " * 5, "en")]
    return [(*r, "a", 1, 2, "b", "c", 3) for r in rows]


@pytest.mark.parametrize("bits,top", [(64, 2000), (64, 3), (6, 2000)])
def test_collocations_against_brute_force(spark, bits, top):
    """Fingerprints of six bits collide all the time; the results stay the same."""
    rows = corpus()
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=3, top=top, bits=bits)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.select(*columns).collect()} == brute(rows, top=top)


def test_empty_table_and_pointers(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus()
    found, totals = frequent_phrases(spark.createDataFrame(rows, SCHEMA), least=3)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    for r in found.collect():
        start = [t[r.some_byte :].decode("utf-8", "replace") for t in texts[r.some_key]]
        assert any(" ".join(pieces(s)[0][: r.words]) == r.phrase for s in start)
    want = Counter()
    for r in rows:
        want[r[2] if r[2] is not None else "und"] += sum(map(len, pieces(r[1])))
    assert {r.lang: r.n for r in totals.collect()} == dict(want)


def test_words_of_any_length_have_one_hash():
    long = b"y" * (BLOCK + 5)
    words = Words(b"ab " * 200_000 + long + b" ab. AB " + long + b"," + long[:-1] + b"  ab")
    texts = [words.data[a:b] for a, b in zip(words.start, words.end)]
    ids, hashes = words.identities(), {}
    for text, h, i in zip(texts, words.hash.tolist(), ids.tolist()):
        assert hashes.setdefault(text, (h, i)) == (h, i)
    assert len(set(hashes.values())) == len(hashes) == 3
    at, prints = words.runs(2)
    assert len(at) == len(words) - 1 - 2


def test_colliding_words_and_runs_come_apart():
    words = Words(b"a b a c a b a c a c")
    words.hash = np.zeros(len(words), np.uint64)  # every word collides
    ids = words.identities()
    assert len(set(ids.tolist())) == 3 and ids[1] == ids[5] != ids[3] == ids[7]
    at, prints = words.runs(2)
    found = {words.phrase(p, 2): n for p, n in verified(words, ids, at, prints * np.uint64(0), 2)}
    assert found == {b"a b": 2, b"b a": 2, b"a c": 3, b"c a": 2}


def test_maps_forget_nothing_and_are_bounded(spark):
    prints = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    known = phrases.bit_map(spark.createDataFrame([(int(p),) for p in prints], "print bigint"))
    assert known.holds(prints.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000, np.uint64)
    assert known.holds(others).mean() < 0.02 and len(known.bits) <= 1 << phrases.MAP_BITS >> 3
