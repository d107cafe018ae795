import random

import pytest

from passbook.llm.lines import drop_common_lines, line_keys

SCHEMA = "doc_id bigint, text string, line string, places string, _key string, _file string, n_lines int"


def key_of(line):
    stripped = line.strip(" \t\n\v\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute(rows, min_docs, min_chars):
    held = {}
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                held.setdefault(key_of(line), set()).add(i)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(held.get(key_of(x), ())) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(seed=4):
    rng = random.Random(seed)
    common = ["Cookie Notice", "  cookie notice\t", "É", "é", "ßx", " cookie notice", "", " ", "a", "\x85a"]
    rows = []
    for i in range(80):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own {rng.randrange(60)}" for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines)))
    rows += [(None, "Cookie notice\nmine"), (3, None), (3, ""), (3, None), (500, "\n"), (501, "cookie notice")]
    rows += [(600, "same\n" * 30_000 + "end"), (601, "x" * 300_000 + "\ncookie notice\r")]
    return [(*r, "l", "p", "k", "f", 1) for r in rows]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 2), (2, 1), (1, 1), (10**6, 1)])
def test_against_brute_force(spark, tmp_path, min_docs, min_chars):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = drop_common_lines(docs, min_docs, min_chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, min_docs, min_chars)
    docs.write.parquet(f"{tmp_path}/docs")
    stored = drop_common_lines(spark.read.parquet(f"{tmp_path}/docs"), min_docs, min_chars)
    assert sorted((tuple(r) for r in stored.collect()), key=str) == brute(rows, min_docs, min_chars)


def test_empty_table_and_keys(spark):
    assert drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted(line_keys(b"A\n a \n\n\tb", 1).values()) == [[0, 1], [3]]
