"""Line dedup where ids do not tell the documents apart."""

from tessera.llm import line_dedup

A, B, C, D = ("the first line of this small text", "another line with words of its own", "some third line, unlike the others",
              "a fourth line that stands nowhere else")
ROWS = [(1, A), (None, f"{A}\n{B}"), (None, f"{C}\n{D}"), (None, f"{B[:-1]}\n{C}x"), (2, f"{D[:-1]}\nshort"), (2, f"own words of the second text\n{B}"),
        (2, f"{D[:-1]}\nshort")]


def test_lines_of_null_and_repeated_ids_stay_apart(spark):
    data = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.drop_lines(data).collect())
    # B stands first in a text of id 2 and D's near form in another: every null-id row loses its own copies alone.
    first = [x for x in got if x[0] != "None"]
    assert first == sorted([("1", A)] + [(str(i), t) for i, t in ROWS if i == 2])
    rest = [t for i, t in got if i == "None"]
    assert "" in rest and len(rest) == 3
    # Of C and its near form, line 0 of one null-id row and line 1 of another, the earlier place stays.
    assert sorted(rest) == sorted(["", C, ""])
    verdicts = line_dedup.line_verdicts(data).collect()
    assert len(verdicts) == 11 and sum(r["kept"] for r in verdicts) == 6
    assert {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in line_dedup.line_summary(data).collect()} == {
        1: (1, 1), 2: (4, 4), None: (6, 1)}
