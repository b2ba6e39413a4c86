"""Conversation prefix trie against a plain version, and its defined cases."""

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import prefix_trie
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_turns int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, _sha(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


def _sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def truth(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children),
                    sum(not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(paths, **settings):
    return sorted(map(tuple, prefix_trie.trie(paths, **settings).select(*COLUMNS).collect()), key=str)


def _random(rng, convs, alphabet, most):
    return [(c, int(t), "user" if t % 2 else None, str(rng.choice(alphabet)))
            for c in range(convs) for t in range(int(rng.integers(0, most)))]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_conversations_equal_brute_force(spark):
    data = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in data.collect()]
    assert result(prefix_trie.rebuilt_paths(data)) == truth(rebuilt(ordered(rows)))


@pytest.mark.parametrize("seed,alphabet", [(1, ["a", "b"]), (2, ["", "é", "same text", "x" * 50]), (3, ["only"])])
def test_random_tries(spark, seed, alphabet):
    rows = _random(np.random.default_rng(seed), 90, alphabet, 7)
    data = _frame(spark, rows)
    assert result(prefix_trie.plain_paths(data)) == truth(ordered(rows))
    assert result(prefix_trie.rebuilt_paths(data)) == truth(rebuilt(ordered(rows)))


def test_defined_cases(spark):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", "x"), (6, 3, "", ""),
            (7, 1, "user", "y"), (10, 2, "a", "b"), (10, 1, "a", "b"), (11, 1, "ab", ""), (12, 1, "a", "b")]
    rows += [(20 + k, 1, "user", "same") for k in range(30)] + [(60, t, "user", "z" * 9) for t in range(300)] + [
        (61, t, "user", "z" * 9) for t in range(299)]
    data = _frame(spark, rows)
    assert result(prefix_trie.plain_paths(data)) == truth(ordered(rows))
    assert result(prefix_trie.rebuilt_paths(data)) == truth(rebuilt(ordered(rows)))
    for none in (data.limit(0), data.where("conv_id is null")):
        assert result(prefix_trie.rebuilt_paths(none)) == []
    one = _frame(spark, [(4, 1, "user", "alone")])
    assert result(prefix_trie.plain_paths(one)) == truth(ordered([(4, 1, "user", "alone")]))


def test_a_narrow_sketch_changes_nothing(spark, monkeypatch):
    rows = _random(np.random.default_rng(9), 60, ["a", "b", "c"], 6)
    monkeypatch.setattr(prefix_trie, "NARROWEST", 64)
    monkeypatch.setattr(prefix_trie, "WIDEST", 64)
    assert result(prefix_trie.plain_paths(_frame(spark, rows))) == truth(ordered(rows))


def test_colliding_digests_are_found(spark, monkeypatch):
    """Lanes of no use for the first salt: everything collides, which the grouping shows."""
    lanes, met = prefix_trie._lanes, []

    def weak(salt):
        met.append(salt)
        return [prefix_trie.F.lit(1).cast("long")] * 4 if salt == 0 else lanes(salt)
    monkeypatch.setattr(prefix_trie, "_lanes", weak)
    rows = _random(np.random.default_rng(4), 30, ["a", "b"], 5)
    assert result(prefix_trie.plain_paths(_frame(spark, rows))) == truth(ordered(rows))
    assert {0, 1} <= set(met)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(3 * k, 1, "user", "same") for k in range(500)] + [(1, 1, "user", "other")]
    assert result(prefix_trie.plain_paths(_frame(spark, rows))) == truth(ordered(rows))
