import gzip
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.llm.classlm import build_model, score_texts
from passbook.llm.crosspolytope import hadamard, nearest
from passbook.llm.pieces import CHARACTER, decode, decode_ids, default_model, encode_sampled, lattices, sample
from passbook.llm.warc import derivatives, responses, write_warc

# --- sampled pieces ---------------------------------------------------------------------------------------------


def odd_texts():
    rng = np.random.default_rng(2)
    signs = list("ab  \n▁é😀\t漢\x00") + [" the", "ing"]
    return ["".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(500)] + ["", "▁", " ", "a" * 5000, "x" * 20_000 + "   "]


def test_decoding_is_lossless_and_seeded_by_row(spark):
    rows = [(i, t, b"i", "x") for i, t in enumerate(odd_texts())] + [(7, None, None, None), (None, "the thing", None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids binary, _text string")
    got = encode_sampled(frame)
    assert got.columns == ["doc_id", "ids", "n_pieces", "ids_crc32", "lossless"]
    first = {(r.doc_id, r.ids_crc32): r for r in got.collect()}
    assert all(r.lossless and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in first.values())
    again = {(r.doc_id, r.ids_crc32) for r in encode_sampled(frame.repartition(7).orderBy(F.rand(1))).collect()}
    assert again == set(first)
    other = {(r.doc_id, r.ids_crc32) for r in encode_sampled(frame, seed=1).collect()}
    assert len(other & again) < len(again)
    back = {r.doc_id: r.text for r in decode_ids(got.where("doc_id != 7"), ids="ids").collect()}
    assert all(back[i] == t for i, t in enumerate(odd_texts()) if i != 7)
    assert encode_sampled(frame.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["thing", "a▁b", "é😀x"])
def test_samples_follow_the_lattice(word):
    lat = lattices(default_model(), 0.7)
    text = " " + word
    weight = {lat.pieces[i]: (i, lat.weights_of[n]) for n, i in enumerate(lat.ids_of) if i >= 0}

    def paths(at):
        if at == len(text):
            yield (), 1.0
            return
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            spelled = part.replace(" ", "▁")
            if "▁" not in part and spelled in weight:
                i, w = weight[spelled]
            elif end == at + 1:
                i, w = CHARACTER + ord(part), lat.rare
            else:
                continue
            for rest, p in paths(end):
                yield (i, *rest), w * p

    whole = {}
    for path, p in paths(0):
        ids = []
        for i in path:
            ids += lat.bytes[list(chr(i - CHARACTER).encode())].tolist() if i >= CHARACTER else [i]
        whole[tuple(ids)] = whole.get(tuple(ids), 0) + p
    total = sum(whole.values())
    drawn = Counter(tuple(x.tolist()) for x in sample([word] * 4000, list(range(4000)), default_model(), 0.7, 42))
    assert set(drawn) <= set(whole)
    for ids, p in whole.items():
        share = p / total
        assert abs(drawn[ids] / 4000 - share) < 5 * math.sqrt(share * (1 - share) / 4000) + 1e-3
    assert decode(np.array(max(drawn, key=drawn.get)), default_model(), 0.7) == word


# --- class n-grams ------------------------------------------------------------------------------------------------


def two_languages(n=240, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [[f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]]
    return [" ".join(rng.choice(vocab[i % 2], rng.integers(3, 60))) for i in range(n)]


def test_scores_against_brute_force(spark):
    texts = [*two_languages(), None, "", "A1 a1\tB1\n", "never seen words", "a1 " * 30_000]
    rows = [(i, t, 1, 2.0) for i, t in enumerate(texts)] + [(None, "a1", 1, 2.0), (3, texts[3], 1, 2.0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_known int, score double")
    got = score_texts(frame, F.col("doc_id") % 7 == 2, k=4, core=200, most=40, passes=4).collect()
    assert len(got) == len(rows)
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts = Counter()
    for i, t, *_ in rows:
        if i is None or i % 7 != 2:
            counts.update(words(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = {
        i: (len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]))
        for i, t, *_ in rows
    }
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert r.base_score == pytest.approx(want[r.doc_id][2])
        assert r.score < 0 and r.held_out == (r.doc_id is not None and r.doc_id % 7 == 2)
    prose = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum(r.score for r in prose) > sum(r.base_score for r in prose) + 0.2 * sum(r.n_tokens for r in prose)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    (r,) = score_texts(frame, F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert score_texts(frame.limit(0), F.lit(True)).count() == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(4)
    k = 3
    trigrams = rng.integers(0, 30, (k + 2, k + 2, k + 2))
    trigrams[:, :, k + 1] = 0
    trigrams[1, 2] = 0
    types = np.array([5, 9, 2])
    m = build_model(trigrams, types, 6, 4, k)
    total = 10 ** m.transition.sum(axis=-1) * 0
    uni = trigrams[:, :, : k + 1].sum(axis=(0, 1))
    for c in range(k):
        total = total + 10 ** m.transition[:, :, c] * (uni[c] - m.discount * types[c]) / uni[c]
    total = total + 10 ** m.transition[:, :, k] + 10**m.unseen
    assert np.allclose(total, 1)


# --- nearest neighbours ------------------------------------------------------------------------------------------


def brute_nearest(rows, asked, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            near = sorted((-float(ok[q] @ v), i) for i, v in ok.items() if i != q)
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, unit):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if not unit:
        x *= rng.uniform(0.5, 1.5, (len(x), 1)).astype("f4")
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest(rows, range(0, 1500, 20), 20)
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({i for _, i in near} & {i for i, _ in got[q].values()})
        for i, s in got[q].values():
            assert s == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)))
    assert hits / 20 / len(want) >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, a, "t", 1) for i in range(60)] + [(100, b, "t", 1), (120, b, "t", 1), (100, b, "t", 1)]
    rows += [(140, None, "t", 1), (160, [0.0, 0.0, 0.0], "t", 1), (180, [1.0, None, 0.0], "t", 1), (200, [float("nan"), 1.0, 0.0], "t", 1)]
    rows += [(220, [float("inf"), 1.0, 0.0], "t", 1), (None, a, "t", 1), (240, [], "t", 1), (260, [1.0], "t", 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, rank int")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[40]] == list(range(20))
    assert [i for i, _ in got[100]] == [120, *range(19)]
    assert nearest(frame.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, a), (1, b)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]


def test_the_transform_keeps_lengths():
    x = np.random.default_rng(8).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


# --- WARC ---------------------------------------------------------------------------------------------------------

PAGE = """<html lang="en"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body>
<!-- <p>gone</p> --><h1>Head</h1><p>One<br>two &lt;3 &copy;</p><a href="/x?a=1&amp;b=2">x</a> <a href='y.html'>y</a>
<img src="//cdn.example.com/i.png"><a href="#top">t</a><a href="https://else.example.org/">z</a></body></html>"""


def test_records_refer_to_their_response(spark):
    rows = [(1, "https://site.example.com/d/p.html?q=1", PAGE, "a"), (2, None, None, "a"), (3, "http://h.example.net", "no tags", "a"), (3, "http://h.example.net", "no tags", "a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string")
    source = responses(pages)
    got = derivatives(source).collect()
    assert len(got) == 8
    mine = {r.record_type: r for r in got if r.page_id == 1}
    assert mine["conversion"].block == "A & B\nHead\nOne\ntwo <3 ©\nx y\ntz"
    lines = mine["metadata"].block.split("\r\n")
    assert lines == [
        "title: A & B", "language: en", "outlinks: 5", "outlink: https://site.example.com/x?a=1&b=2",
        "outlink: https://site.example.com/d/y.html", "outlink: https://cdn.example.com/i.png",
        "outlink: https://site.example.com/d/p.html#top", "outlink: https://else.example.org/", "",
    ]
    first = {r.page_id: r for r in source.collect()}
    for r in got:
        s = first[r.page_id]
        assert (r.refers_to, r.source_headers, r.source_digest) == (s.record_id, s.http_headers, s.payload_digest)
        assert r.content_length == len(r.block.encode())
    assert mine["conversion"].concurrent_to == mine["metadata"].record_id
    assert mine["metadata"].concurrent_to == mine["conversion"].record_id
    assert {r.block for r in got if r.page_id == 2} == {"", "title: \r\nlanguage: \r\noutlinks: 0\r\n"}
    assert derivatives(responses(pages.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "u", "<p>" + "<" * 100_000 + "x" * 500_000)], "page_id bigint, url string, html string")
    assert derivatives(responses(long)).where("record_type = 'conversion'").first().content_length == 600_000


def test_files_can_be_parsed_again(spark, sf_dir, tmp_path):
    from passbook.llm.queries import op9_warc_derivatives

    records = op9_warc_derivatives(spark, sf_dir)
    write_warc(records, f"{tmp_path}/warc")
    found = {}
    for path in (tmp_path / "warc").glob("*.gz"):
        data = gzip.open(path).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            assert data[n : n + 4] == b"\r\n\r\n"
            found[fields["WARC-Record-ID"]] = (fields["WARC-Refers-To"], fields["WARC-Block-Digest"], data[:n].decode())
            data = data[n + 4 :]
    assert found == {r.record_id: (r.refers_to, r.block_digest, r.block) for r in records.collect()}


def test_ties_between_different_vectors_go_to_the_smaller_id(spark):
    """All others have the inner product 0.5 with the query; in whichever order rows come, the smallest ids are found."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, np.cos(i) / 2, np.sin(i) / 2]) for i in range(1, 1500)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    for order in (frame.repartition(3), frame.orderBy(F.desc("vec_id")).coalesce(1)):
        got = nearest(order, F.col("vec_id") == 0, k=20, tables=12, probes=8).orderBy("rank").collect()
        assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {0.5}
