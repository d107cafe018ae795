import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from passbook.llm import jaccard
from passbook.llm.jaccard import near_copies

CROWD = 32


def brute_sets(texts, words):
    out = []
    for t in texts:
        found = (t or "").lower().split()
        k = min(words, len(found))
        out.append({tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set())
    return out


def brute_roots(texts, words=5, similarity=0.8):
    sets, root = brute_sets(texts, words), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) >= similarity * len(a | b)):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return [top(i) for i in range(len(texts))]


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"w{rng.randrange(10**6)}"
    return out


def corpus(seed=5):
    """Texts with copies of 1 to 8 edits, a large family, a passage that many share, and odd texts."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, root = text(60), text(200)
    out = [text(rng.randint(5, 200)) for _ in range(60)]
    out += [edited(rng, t, rng.randint(1, min(8, len(t)))) for t in out for _ in range(2)]
    out += [passage + text(100) for _ in range(2 * CROWD)]
    out += [edited(rng, out[-7], 3), edited(rng, out[-9], 2)]
    out += [edited(rng, root, rng.randint(1, 6)) for _ in range(2 * CROWD)]
    texts = [" ".join(t) for t in out] + ["", None, " \n", "two words", "Two  words", "x " * 30_000, "x " * 30_001]
    rng.shuffle(texts)
    return texts


def test_classes_against_brute_force_jaccard(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert got == dict(enumerate(brute_roots(texts)))
    assert near_copies(docs.limit(0)).count() == 0


def test_links_do_not_depend_on_the_order(spark, monkeypatch):
    """Without an estimate of what is common, crowded entries go through more rounds and give the same classes."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "MEETING", 4)
    texts = corpus(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert got == dict(enumerate(brute_roots(texts)))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 700, 5000):
        for _ in range(20):
            base = rng.integers(0, 1 << 63, n, np.uint64)
            keep, new = rng.random(n) < rng.uniform(0.5, 1), rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), np.uint64)
            a, b = np.unique(base), np.unique(np.append(base[keep], new))
            differ = np.bitwise_count((jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64)).sum()
            assert differ <= len(np.setxor1d(a, b)) and jaccard.bitmap(a).shape == (16,)


@pytest.mark.parametrize("pairs", [400, 2000])
def test_a_template_hides_no_pair(spark, pairs):
    """404 words are in every text, 10 more in both of a pair (similarity 0.817, any other two 0.781)."""
    rng = random.Random(pairs)
    template, rows = [f"t{i}" for i in range(404)], []
    for p in range(pairs):
        both = [f"b{p}_{i}" for i in range(10)]
        for side in range(2):
            rows.append((2 * p + side, " ".join(template + both + [f"o{p}_{side}_{i}" for i in range(46)])))
    rng.shuffle(rows)
    found = near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(2 * pairs)}


def test_the_stage_goes_through_the_anchor_cover(spark, sf_dir, monkeypatch):
    """Of long texts with a word edited, the cover proposes those within its bits; the exact way never compares these again."""
    rng, rounds, proposed = random.Random(4), [], []
    words = [[f"w{rng.randrange(10**5)}" for _ in range(3000)] for _ in range(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:-1], "other"])) for i, w in enumerate(words)]
    prints = [jaccard.fingerprint(jaccard.shingles(t.encode(), 5)) % (1 << 64) for _, t in rows]
    within = sum((x ^ y).bit_count() <= jaccard.REACH for x, y in combinations(prints, 2))
    anchored, pairs = jaccard.anchored, jaccard._pairs

    def propose(*args):
        proposed.append(anchored(*args))
        return proposed[-1]

    def turn(*args):
        rounds.append(pairs(*args))
        return rounds[-1]

    monkeypatch.setattr(jaccard, "anchored", propose)
    monkeypatch.setattr(jaccard, "_pairs", turn)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == list(range(10))
    known = {tuple(r) for r in proposed[0].collect()}
    assert len(known) == within > 5
    assert rounds[0][2].count() == 10 - within and not known & {tuple(r) for r in rounds[0][2].collect()}


def test_fingerprints_are_majorities_of_the_set():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 100):
        found = rng.integers(0, 1 << 64, n, np.uint64)
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in found.tolist()) * 2 > n)
        assert jaccard.fingerprint(found) % (1 << 64) == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_the_stage_drops_copies_with_a_few_edited_words(spark, sf_dir, edits):
    rng = random.Random(edits)
    words = [[f"w{rng.randrange(10**5)}" for _ in range(150)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    rows += [(100 + i, " ".join(edited(rng, w, edits))) for i, w in enumerate(words)]
    texts = [t for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [rows[i][0] for i, r in enumerate(brute_roots(texts)) if i == r]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == want == list(range(20))


def test_only_tables_keyed_by_one_number_are_broadcast(spark, monkeypatch):
    """Any other broadcast table takes a whole page of every executor, and each round would leave some there."""
    plans, saved, more = [], jaccard.saved, jaccard.saved_more
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(jaccard, "saved", lambda df, name: seen(df) or saved(df, name))
    monkeypatch.setattr(jaccard, "saved_more", lambda df, name, paths: seen(df) or more(df, name, paths))
    rng = random.Random(7)
    words = [[f"w{rng.randrange(10**5)}" for _ in range(150)] for _ in range(10)]
    texts = [" ".join(w) for w in words] + [" ".join(edited(rng, w, 2)) for w in words] + ["", None]
    docs = spark.createDataFrame([((i % 3 == 0, i), t) for i, t in enumerate(texts)], "key struct<odd: boolean, id: bigint>, text string")
    got = {r.key.id: r.component_id.id for r in near_copies(docs, key="key").collect()}
    roots, least = brute_roots(texts), {}
    for i in sorted(range(len(texts)), key=lambda i: (i % 3 == 0, i)):
        least.setdefault(roots[i], i)
    assert got == {i: least[r] for i, r in enumerate(roots)}
    keys = [m.split(", ") for plan in plans for m in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)]
    assert keys and all(len(k) == 1 and re.fullmatch(r"\w+#\d+L", k[0]) for k in keys), keys
