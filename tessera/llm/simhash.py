"""SimHash near-dedup: 64-bit fingerprints joined by pigeonring filtering.

A bit of a text's fingerprint is set when it is set in over half of the
hashes of its word shingles, repeats included.  Fingerprints link when at
most ``bound`` bits differ.

The 64 bits are cut into ``bound + 1`` segments that stand in a ring.  If two
fingerprints differ in at most ``bound`` bits, then from some segment on every
chain of l consecutive segments holds at most ``l - 1`` differences (the
pigeonring principle with the budget ``l * bound / (bound + 1)``).  So the
first segment of such a chain is equal and the second differs in one bit at
most; these two steps are the join key:

* every fingerprint stands under the key (start, first two segments),
* and is looked for under that key and under the key without each one of the
  set bits of its second segment (of two that differ in one bit, one has it).

The longer chains are tested on the joined pair before the whole distance is.

A key under which many more fingerprints stand than under others (``crowd``
and four times their fair share) would make pairs with the square of their
number.  The fingerprints that meet such a key are linked without pairs: each one lists all points within ``bound / 2`` bits
of itself, and two of them share a point exactly when at most ``bound`` bits
differ, so all at a point are linked with the smallest of them.

Equal fingerprints are one node from the start, and components of nodes come
from minimum labels.

Defined cases: a text without words, or null, has fingerprint zero and links
like any other; fewer than ``width`` words are one shingle; rows of one id
with several texts are one document, so their fingerprints are linked; rows
with a null id link like others but never name a component, which is null
when only they are in it; repeated rows give repeated results; no documents
give no rows; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, ship, written
from tessera.llm.minhash import components

ship(__name__)

BITS = 64
CROWD = 16
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
_space = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str, width: int):
    """Arrays of XXH64 (seed 42) of the text's shingles, one block of the text after the other."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    raw = text.encode().lower()
    at, carry, any_made = 0, [], False
    while at < len(raw):
        stop = _space.search(raw, min(at + BLOCK, len(raw)))
        end = stop.start() if stop else len(raw)
        words = carry + raw[at:end].split()
        at = end
        n = len(words) - width + 1
        if n > 0:
            yield np.fromiter((digest(b" ".join(words[i:i + width]), seed=42) for i in range(n)), np.uint64, n)
            any_made, words = True, words[n:]
        carry = words
    if carry and not any_made:
        yield np.array([digest(b" ".join(carry), seed=42)], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k:k + (1 << 16)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint as a long). Texts stay in their task."""
    def work(batches):
        for batch in batches:
            made = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(work, "doc_id long, fp long")


def segments(bound: int) -> list[tuple[int, int]]:
    """(offset from the highest bit, width) of the ring's segments."""
    n = bound + 1
    widths = [BITS // n + (k < BITS % n) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _turned(x: str, offset: int) -> str:
    return f"(shiftleft({x}, {offset}) | shiftrightunsigned({x}, {BITS - offset}))" if offset else x


def _reach(ring: list[tuple[int, int]], start: int, length: int) -> int:
    """Bits in ``length`` segments from ``start`` on."""
    return sum(ring[(start + k) % len(ring)][1] for k in range(length))


def standing_keys(marks: DataFrame, bound: int) -> DataFrame:
    """(fp, key) for every start of a chain: the start and the first two segments from there on."""
    ring = segments(bound)
    keys = [f"shiftrightunsigned({_turned('fp', at)}, {BITS - _reach(ring, k, 2)}) | {k << 58}L"
            for k, (at, _) in enumerate(ring)]
    return marks.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))


def sought_keys(marks: DataFrame, bound: int) -> DataFrame:
    """(fp, key, same): the standing keys, and those keys without one of the set bits of the second segment."""
    ring = segments(bound)
    standing = standing_keys(marks, bound)
    width = F.lit(None)
    for k in range(len(ring)):
        width = F.when(F.shiftrightunsigned("key", 58) == k, F.lit(ring[(k + 1) % len(ring)][1])).otherwise(width)
    cleared = F.expr("transform(filter(sequence(0, width - 1), i -> getbit(key, i) = 1), i -> key - shiftleft(1L, i))")
    return standing.withColumn("width", width).select(
        "fp", F.col("key").alias("own"), F.explode(F.concat(F.array("key"), cleared)).alias("key")).select(
        "fp", "key", (F.col("own") == F.col("key")).alias("same"))


def chain_condition(x: str, key: str, bound: int) -> str:
    """Whether every chain from the key's start on stays within its budget, and then the whole distance."""
    ring, cases = segments(bound), []
    for k, (at, _) in enumerate(ring):
        tests = [f"bit_count(shiftrightunsigned({_turned(x, at)}, {BITS - _reach(ring, k, n)})) <= {n - 1}"
                 for n in range(2, bound + 1)]
        cases.append(f"when {k} then {' and '.join(tests) or 'true'}")
    return f"(case shiftrightunsigned({key}, 58) {' '.join(cases)} end) and bit_count({x}) <= {bound}"


def _flips(radius: int) -> list[int]:
    """All patterns of at most ``radius`` bits."""
    made, last = [0], [0]
    for _ in range(radius):
        last = sorted({x ^ (1 << i) for x in last for i in range(BITS)} - set(made))
        made += last
    return [x - (1 << BITS) if x >> 63 else x for x in made]


def near_points(members: DataFrame, bound: int) -> DataFrame:
    """(a, b) that connect the fingerprints of ``members`` (fp) as ``bound`` or fewer differing bits do.

    Two members share a point within r bits of both exactly when at most 2 * r bits differ. Smaller r come first:
    what they connect has one label from then on, so that a dense group hardly makes any edges."""
    labelled, edges = written(members.select("fp", F.col("fp").alias("label")), "members"), None
    for radius in range(1, bound // 2 + 1):
        listed = F.array(*[F.lit(x) for x in _flips(radius)])
        points = labelled.repartition("fp").select("label", F.explode(F.transform(listed, lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
        several = points.groupBy("point").agg(F.min("label").alias("a"), F.max("label").alias("high")).where("a < high")
        # Points compress so well that their table looks small enough to broadcast, which it is not.
        new = written(points.join(several.select("point", "a").hint("merge"), "point").where("a < label").select("a", F.col("label").alias("b")).distinct(),
                      "point-edges")
        edges = new if edges is None else edges.unionByName(new)
        if 2 * radius < bound:
            joined = components(new).select(F.col("id").alias("label"), "component")
            labelled = written(labelled.join(joined, "label", "left").select("fp", F.coalesce("component", "label").alias("label")), "members")
    return edges


def links(marks: DataFrame, bound: int = 4, crowd: int = CROWD) -> DataFrame:
    """(a, b) that connect the different fingerprints of ``marks`` (fp, each once) as ``bound`` or fewer differing bits do."""
    if bound < 2 or bound % 2 or bound > 16:
        raise ValueError("bound must be an even number from 2 to 16")
    standing, sought = standing_keys(marks, bound), sought_keys(marks, bound)
    narrowest = min(_reach(segments(bound), k, 2) for k in range(bound + 1))
    most = crowd + 4 * marks.count() // (1 << narrowest)
    crowded = written(standing.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "crowded")
    calm = sought.join(crowded, "key", "left_anti")
    meet = F.expr("p.key = q.key") & F.expr("(not p.same and p.fp <> q.fp) or p.fp < q.fp")
    # Keys come from an explode, which Spark sizes as its input: 36 times their table look small enough to broadcast.
    found = calm.alias("p").join(standing.hint("merge").alias("q"), meet & F.expr(chain_condition("(p.fp ^ q.fp)", "p.key", bound)))
    pairs = found.select(F.expr("least(p.fp, q.fp)").alias("a"), F.expr("greatest(p.fp, q.fp)").alias("b"))
    if crowded.isEmpty():
        return pairs.distinct()
    members = sought.join(crowded, "key", "left_semi").select("fp").distinct()
    return pairs.unionByName(near_points(members, bound)).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, bound: int = 4, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(docs, width), "fingerprints")
    marks = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "marks")
    # Written, so that Spark knows their size and does not broadcast the rows of all documents in their place.
    several = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("high"))
                      .where("a < high").select("doc_id", "a"), "several")
    of_one_id = rows.join(several, "doc_id").where("a < fp").select("a", F.col("fp").alias("b"))
    found = components(links(marks.select("fp"), bound, crowd).unionByName(of_one_id))
    rooted = written(marks.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The documents whose id names their component, all columns; documents without an id stay."""
    kept = near_duplicates(docs, **settings).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
