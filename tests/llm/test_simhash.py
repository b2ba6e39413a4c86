"""SimHash near-dedup against brute force over all pairs, and its defined cases."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tests.conftest import SF

SCHEMA = "doc_id long, text string, fp string, key int"


def plain_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def truth(rows, bound=4):
    """(id, fingerprint, component) of every row; rows of one id are linked."""
    f = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = rows[a][0] is not None and rows[a][0] == rows[b][0]
        if same or (f[a] ^ f[b]).bit_count() <= bound:
            root[_find(root, b)] = _find(root, a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[_find(root, k)] = min(i, least.get(_find(root, k), i))
    return sorted(((i, f"{f[k]:016x}", least.get(_find(root, k))) for k, (i, _) in enumerate(rows)), key=str)


def result(spark, rows, **settings):
    data = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    return sorted(map(tuple, simhash.near_duplicates(data, **settings).collect()), key=str)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == truth(rows) and len({r[2] for r in got}) < len(got)


def test_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(0, None), (1, ""), (2, " \n\t\x0b "), (3, "One two"), (4, "one  TWO"), (4, "one  TWO"), (4, "another text of many words here"),
            (5, long), (6, long + " x"), (None, "a text of its own without id"), (None, long), (7, "Ünï x É é"), (8, "ünï x É é")]
    assert result(spark, rows) == truth(rows)
    assert result(spark, [(None, "a b"), (None, "a b")]) == truth([(None, "a b"), (None, "a b")])
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_copies(spark.createDataFrame([(9, "a b", "c", 1), (3, "A b", "c", 1), (None, "a b", "c", 1)], SCHEMA)
                                    ).select("doc_id").collect() == [(3,), (None,)]


@pytest.mark.parametrize("block", [7, 40])
def test_blocks_of_a_text_change_nothing(block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(block)
    for n in (1, 3, 4, 5, 60):
        text = " \n".join("w" * int(k) for k in rng.integers(1, 30, n)) + " "
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def _marks(rng, number):
    """Fingerprints in chains and dense groups of up to six differing bits, and lone ones."""
    made = [int(x) for x in rng.integers(0, 1 << 63, number // 4)]
    while len(made) < number:
        x = made[int(rng.integers(len(made)))]
        for b in rng.choice(64, int(rng.integers(1, 7)), False):
            x ^= 1 << int(b)
        made.append(x)
    return sorted({x - (1 << 64) if x >> 63 else x for x in made})


def _classes(marks, edges):
    root = {m: m for m in marks}
    for a, b in edges:
        x, y = sorted((_find(root, a), _find(root, b)))
        root[y] = x
    return {m: _find(root, m) for m in marks}


@pytest.mark.parametrize("bound,crowd", [(4, 128), (4, 1), (4, 0), (2, 128), (2, 3), (6, 128)])
def test_links_connect_what_brute_force_connects(spark, bound, crowd):
    marks = _marks(np.random.default_rng(bound * 1000 + crowd), 60 if crowd == 0 else 400)
    near = [(a, b) for a, b in itertools.combinations(marks, 2) if ((a ^ b) % (1 << 64)).bit_count() <= bound]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long"), bound, crowd).collect()]
    assert _classes(marks, got) == _classes(marks, near)
    if crowd == 128:
        assert len(got) == len(set(got)) and set(got) == set(near)


def test_a_crowded_group_makes_few_links(spark):
    """Two thousand fingerprints around one point: links grow with the members, not with their pairs."""
    rng = np.random.default_rng(1)
    marks = sorted({sum(1 << int(b) for b in rng.choice(62, 2, False)) for _ in range(4000)} | {0})
    data = spark.createDataFrame([(m,) for m in marks], "fp long")
    got = [tuple(r) for r in simhash.links(data, 4, crowd=16).collect()]
    assert len(marks) > 1500 and set(_classes(marks, got).values()) == {0}
    assert len(got) < 70 * len(marks)


def test_bound_must_be_even(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def _broadcast(df):
    """Of each broadcast in the plan: the operators below it."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            found.append(list(itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[k + 1:])))
    return found


def test_only_small_sides_are_broadcast(spark):
    # Spark sizes exploded keys as the table they come from, which is under its threshold here, and joined tables far above it.
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("fp"))
    plans = _broadcast(simhash.links(simhash.written(rows.select("fp"), "marks"), 4))
    assert plans and not any("Generate" in x for p in plans for x in p)
    out = simhash.near_duplicates(spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), "id").alias("text")))
    scans = [x for p in _broadcast(out) for x in p if "FileScan" in x]
    assert scans and not any("[doc_id" in x for x in scans)
