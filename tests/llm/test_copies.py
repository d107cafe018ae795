import re
from collections import defaultdict
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passbook.llm.common import join_groups
from passbook.llm.components import components
from passbook.llm.dedup import exact_duplicates
from passbook.llm.simhash import RADIUS, all_anchors, cosets, home_anchors, links, near_duplicates, syndromes

SCHEMA = "doc_id bigint, text string, _key string, _text string, fp string, keep_id string"
ROWS = [
    (1, "a b  c", "x", None, None, "k"),
    (2, "abc", "x", "y", "z", None),
    (3, "a b\tc\n\x0b", None, "y", "z", "k"),
    (4, "", "x", "y", "z", "k"),
    (5, None, "x", "y", "z", "k"),
    (6, "a b c", "x", "y", "z", "k"),
    (7, "long " * 40_000, "x", "y", "z", "k"),
    (8, "long " * 40_000 + "x", "x", "y", "z", "k"),
    (9, "abc", "x", "y", "z", "k"),
    (9, "abc", "x", "y", "z", "k"),
    (None, "only", "x", "y", "z", "k"),
    (None, "on ly", "x", "y", "z", "k"),
    (12, "only", "x", "y", "z", "k"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[norm].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [
            (m[3], best[3], len(members), m == best, members.count(best), sha256(norm.encode()).hexdigest()) for m in members
        ]
    return sorted(out, key=str)


@pytest.mark.parametrize("all_digests", [True, False])
def test_exact_duplicates_against_brute_force(spark, all_digests):
    got = [tuple(r) for r in exact_duplicates(spark.createDataFrame(ROWS, SCHEMA), 3, all_digests).collect()]
    want = brute_exact(ROWS)
    if not all_digests:
        got = [(*r[:5], None) for r in got]
        want = [(*r[:5], None) for r in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_digests_of_survivors_only(spark):
    rows = exact_duplicates(spark.createDataFrame(ROWS, SCHEMA), all_digests=False).where("doc_id IN (6, 1)").collect()
    assert {r.doc_id: r.text_sha256 is None for r in rows} == {6: True, 1: False}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(none).count() == 0
    assert near_duplicates(none).count() == 0


def test_groups_join_hot_and_cold(spark):
    rows = spark.range(6000).select((F.col("id") % 3 * 1000 + F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(0)).alias("k"))
    groups = rows.groupBy("k").count()
    joined = join_groups(rows, groups.where("k != 1001"), ["k"], "count", 6000, "left")
    assert joined.count() == 6000
    assert joined.where("k = 0 AND count = 2000").count() == 2000
    assert joined.where("count IS NULL").count() == rows.where("k = 1001").count()


def brute_fingerprint(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(prints, max_bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= max_bits:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words, 400))
    texts = [base, base + " end", base.replace("w1 ", "w2 ", 1), base.upper(), "", None, " \n ", "One two", "one  TWO", "w1", "Ä ä"]
    texts += [" ".join(rng.choice(words, 20)) for _ in range(30)] + [base + f" x{i}" for i in range(20)]
    rows = [(i, t, "x", "y", "z", "k") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [brute_fingerprint(t, 3) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_classes(prints)
    distinct = set(prints)
    assert [got[i].links for i in range(len(texts))] == [sum(0 < (p ^ q).bit_count() <= 2 for q in distinct) for p in prints]


def test_repeated_and_null_keys(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (3, "a b c d")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(1, 1), (1, 1), (3, 1), (None, 1), (None, None)]


def test_code_covers_every_word():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    patterns, weights, starts = cosets(RADIUS)
    group = syndromes(words)
    assert (np.diff(starts) == 1).all() and weights.max() == RADIUS
    assert (syndromes(words ^ patterns[starts[group]]) == 0).all()


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_a_home_is_among_the_anchors_of_all_neighbours(max_bits):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
    y = x.copy()
    for _ in range(max_bits):
        y ^= np.int64(1) << rng.integers(0, 64, 200)
    home = home_anchors(x)
    row, anchor = all_anchors(y, max_bits)
    assert all(h in anchor[row == i] for i, h in enumerate(home))


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(1 << 63), (1 << 63) - 1, 20)
    prints = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(15):
            t = s
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                t ^= -(1 << 63) if b == 63 else 1 << b
            prints.add(t)
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {(r.a, r.b) for r in links(frame, 2).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a, b in combinations(sorted(prints), 2) if ((a ^ b) & mask).bit_count() <= 2}
    assert got == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
