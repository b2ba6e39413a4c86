"""Line dedup under other edit bounds and shortest forms, against all pairs by plain Levenshtein distance."""

import itertools

import numpy as np
import pytest

from tessera.llm import line_dedup


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _truth(rows, edits, min_chars):
    lines = sorted((i is None, i or 0, k, x.strip(" \t\n\x0b\x0c\r").lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")))
    forms = {}
    for *place, x in lines:
        if x:
            forms.setdefault(x, tuple(place))
    near = {x: [at] for x, at in forms.items()}
    for a, b in itertools.combinations([f for f in forms if len(f) >= min_chars], 2):
        if edits and abs(len(a) - len(b)) <= edits and _distance(a, b) <= edits:
            near[a].append(forms[b])
            near[b].append(forms[a])
    return {(None if null else i, k): min(near[x]) for null, i, k, x in lines if x}


def _rows(seed, n):
    rng = np.random.default_rng(seed)
    base = ["the quick brown fox jumps over it", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab", "ähnlich ïst 𝔡ïese zeile", "short", "ab", "q"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(4):
            x = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 4)):
                k = int(rng.integers(len(x) + 1))
                x[k:k + int(rng.integers(0, 2))] = list(rng.choice(["", "z", "a", "𝔡"]))
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    return [*rows, (n, None), (n + 1, ""), (None, "\n".join(base)), (n + 2, "The quick brown fox jumps over them")]


@pytest.mark.parametrize("edits,min_chars", [(0, 20), (1, 1), (2, 20), (2, 1)])
def test_equals_all_pairs(spark, edits, min_chars):
    rows = _rows(edits + min_chars, 40)
    data = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, form string, place int").repartition(3)
    got = {(r["doc_id"], r["line"]): (r["first_doc_id"] is None, r["first_doc_id"] or 0, r["first_line"])
           for r in line_dedup.line_verdicts(data, edits=edits, min_chars=min_chars).collect()}
    truth = _truth(rows, edits, min_chars)
    assert got == truth
    gone = {i: sorted(k for (d, k), first in truth.items() if d == i and first != (i is None, i or 0, k)) for i, _ in rows}
    summary = line_dedup.line_summary(data, edits=edits, min_chars=min_chars).collect()
    assert {r["doc_id"]: r["dropped"] for r in summary} == gone
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(data, edits=edits, min_chars=min_chars).collect()}
    assert kept == {i: t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_two_edits_on_a_long_line_and_many_alike(spark):
    """One line of 700 characters, and a group of 300 lines that differ in two characters from each other."""
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefgh "), 700)).strip("  ") + "x"
    alike = [f"line number {chr(97 + k // 18)} of this table, item {chr(97 + k % 18)}, ends" for k in range(300)]
    rows = [(0, long), (1, long[:350] + "Z" + long[351:] + "y"), (2, "y" + long[:200] + long[203:]), *((10 + k, x) for k, x in enumerate(alike))]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc_id"] for r in line_dedup.line_verdicts(data, edits=2).collect()}
    assert got == {0: 0, 1: 0, 2: 2, **{10 + k: 10 for k in range(300)}}


def test_within_equals_levenshtein():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice(list("ab"), rng.integers(0, 8))) for _ in range(2))
        for edits in (0, 1, 2):
            assert line_dedup.within(a, b, edits) == (_distance(a, b) <= edits)


def test_keys_of_complementary_texts_differ():
    """Thue-Morse words, which sums of powers modulo 2**64 cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    words = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    first = [int(next(line_dedup._gapped_keys(w))[0][0]) for w in words]
    assert first[0] != first[1]


@pytest.mark.parametrize("edits,min_chars", [(3, 20), (-1, 20), (1, 0)])
def test_parameters_out_of_reach(spark, edits, min_chars):
    with pytest.raises(ValueError):
        line_dedup.line_verdicts(spark.createDataFrame([], "doc_id long, text string"), edits=edits, min_chars=min_chars)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_verdicts(empty, edits=2).count() == 0 and line_dedup.drop_lines(empty, edits=2).count() == 0
