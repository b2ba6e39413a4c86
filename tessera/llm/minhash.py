"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges, exact confirmation.

1. Every document becomes its set of distinct word shingles (128-bit hashes),
   one permutation hash per shingle, and the minimum per bin; empty bins copy
   a bin chosen by a fixed random sequence (optimal densification), so equal
   sets fill equal bins.  Groups of consecutive bins are the bands.
2. Documents with equal sets are one node, and the sets of one id are linked.
3. In each bucket (band, key) the smallest ids are centres, and every other
   member is paired with them: candidate pairs grow with the members of a
   bucket, not with their square.  The first round takes one centre, the
   second the next few, and only for members that are still apart.
4. What remains: buckets with more members than centres that still hold
   several components.  Their members are joined by the prefix rule instead,
   which misses nothing: with shingles ordered from rare to frequent, two sets
   of similarity t share a shingle among the first (1 - t) of each.  Pairs
   already in one component are left out.
5. Each pair is confirmed on the full sets, and components follow by
   repeated minimum labels, cut by written tables.

Defined cases: a text without words has no shingles and links with nothing;
fewer than ``width`` words are one shingle; rows that repeat id and set are
one document; the sets of one id with several texts are linked with each other,
so its rows share a component; a row with a null id is its own component (null) and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import id_and_text, one_of_each, ship, written

ship(__name__)

BANDS, ROWS = 24, 4
CENTRES = 4
_state: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str) -> np.ndarray:
    """A 128-bit hash of each word, as two numbers; A-Z are lower-cased and words end at ASCII white space."""
    import xxhash

    words = text.encode().lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 128-bit hashes of the text's shingles, as rows of two numbers."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    made = np.full((n, 2), min(width, len(words)), np.uint64)
    made[:, 1] += np.uint64(1 << 32)
    for k in range(min(width, len(words))):
        made = _mix(made * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n])
    made = made[np.lexsort((made[:, 1], made[:, 0]))]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]).any(1)
    return np.ascontiguousarray(made[new])


def shared_shingles(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets share; a shingle is equal when both of its numbers are."""
    both = np.concatenate((x, y))
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return int((both[1:] == both[:-1]).all(1).sum())


def _donors(bins: int) -> np.ndarray:
    """For each bin the bins it tries to copy, in order; each sequence reaches every bin."""
    if ("donors", bins) not in _state:
        rng = np.random.default_rng(20177)
        _state["donors", bins] = np.stack([rng.permutation(bins) for _ in range(bins)])
    return _state["donors", bins]


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Minimum per bin under one permutation, densified."""
    values = _mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    at = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at.astype(np.int64), values)
    full = np.zeros(bins, bool)
    full[at.astype(np.int64)] = True
    if not full.all():
        donors = _donors(bins)
        empty = np.flatnonzero(~full)
        least[empty] = least[donors[empty, full[donors[empty]].argmax(1)]]
    return least


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    least = signature(shingles[:, 0], bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + least[:, k])
    return key.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One narrow row per input row: doc_id, text_sha256, n_shingles, set_hash (128 bits), bands. Texts stay in their task."""
    def work(frames):
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"].array, frame["text"]):
                s = shingle_set(text, width)
                digest = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
                whole = hashlib.sha256(text.encode()).hexdigest()
                out.append((doc, whole, len(s), digest, band_keys(s, bands, rows) if len(s) else []))
            made = pd.DataFrame(out, columns=["doc_id", "text_sha256", "n_shingles", "set_hash", "bands"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return id_and_text(docs).mapInPandas(
        work, "doc_id long, text_sha256 string, n_shingles long, set_hash binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles, seconds) of the wanted (id, doc_id, set_hash): both numbers of each shingle. The texts of one
    doc_id are told apart by their set's hash."""
    def work(frames):
        for frame in frames:
            keep, firsts, seconds = [], [], []
            for node, text, digest in zip(frame["id"], frame["text"], frame["set_hash"]):
                s = shingle_set(text, width)
                if hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() == bytes(digest):
                    keep.append(node)
                    firsts.append(np.ascontiguousarray(s[:, 0]).view(np.int64))
                    seconds.append(np.ascontiguousarray(s[:, 1]).view(np.int64))
            yield pd.DataFrame({"id": pd.array(keep, "Int64"), "shingles": firsts, "seconds": seconds})

    texts = id_and_text(docs).join(wanted.select("id", "doc_id", "set_hash"), "doc_id")
    made = texts.select("id", "text", "set_hash").mapInPandas(work, "id long, shingles array<long>, seconds array<long>")
    return made.dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("seconds").alias("x2")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("seconds").alias("y2")), "b"))

    def work(frames):
        for frame in frames:
            ok = []
            for x, x2, y, y2 in zip(frame["x"], frame["x2"], frame["y"], frame["y2"]):
                # Most pairs show by the first numbers alone, which share at least as much.
                shared = len(np.intersect1d(x, y))
                if good := 100 * shared >= percent * (len(x) + len(y) - shared):
                    shared = shared_shingles(np.stack((x, x2), 1), np.stack((y, y2), 1))
                    good = 100 * shared >= percent * (len(x) + len(y) - shared)
                ok.append(good)
            yield frame.loc[ok, ["a", "b"]]

    return both.select("a", "b", "x", "x2", "y", "y2").mapInPandas(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the smallest id reachable, by minimum labels and label jumps."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "edges")
    # The first round needs no labels: every id starts as its own.
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a")
                .agg(F.min("label").alias("near")))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        hop = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        moved = written(lower.join(hop, "next").select("id", "old", F.least("next", "far").alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def set_nodes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, set_hash): the node of every different set (set_hash, doc_id, id) with the smallest doc_id that
    has it, and edges (a, b) between the nodes of one doc_id.

    A node's id is that doc_id; of several sets with the same one, all but one get unique ids below every doc_id."""
    classes = written(named.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id")), "classes")
    speaks = classes.groupBy("doc_id").agg(F.min("set_hash").alias("first"), F.max("set_hash").alias("last")).where("first < last")
    silent = written(classes.join(speaks, "doc_id").where("set_hash > first").select("set_hash", "doc_id"), "silent")
    below = F.least(F.lit(0), F.lit(classes.agg(F.min("doc_id")).first()[0])) - 1
    other = written(silent.withColumn("own", below - F.monotonically_increasing_id()), "silent")
    classes = written(classes.join(other.select("set_hash", "own"), "set_hash", "left")
                      .select("set_hash", "doc_id", F.coalesce("own", "doc_id").alias("id")), "classes")
    several = (named.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low < high")
               .select("doc_id"))
    apart = (named.select("doc_id", "set_hash").join(several, "doc_id").distinct()
             .join(classes.select("set_hash", "id"), "set_hash").select("doc_id", "id"))
    least = apart.groupBy("doc_id").agg(F.min("id").alias("a"))
    return classes, apart.join(least, "doc_id").where("a < id").select("a", F.col("id").alias("b")).distinct()


def near_rows(docs: DataFrame, width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS,
              centres: int = CENTRES, link_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, text_sha256, set_hash, n_shingles, component_id, kept, and stands: whether its
    set stands for the component (rows without id or words stand for themselves).

    ``link_ids``: whether the sets of one id are linked, so that every id has one component."""
    sketch = written(sketches(docs, width, bands, rows), "sketches")
    named = sketch.where("doc_id is not null and n_shingles > 0")
    classes, of_one_id = set_nodes(named)
    nodes = written(named.join(classes, ["doc_id", "set_hash"]).dropDuplicates(["id"])
                    .select("id", "doc_id", "set_hash", "n_shingles", "bands"), "nodes")
    members = nodes.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))

    nth = F.row_number().over(Window.partitionBy("band", "key").orderBy("id"))
    heads = (members.select("band", "key", "id", "n_shingles", nth.alias("nth")).where(f"nth <= {centres + 1}")
             .groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("id", "n_shingles"))).alias("heads"))
             .where("size(heads) > 1"))
    # Members of buckets with company, with the bucket's smallest members.
    shared = written(members.join(heads, ["band", "key"]), "buckets")
    alike = f"least(n, m) * 100 >= greatest(n, m) * {percent}"

    def star(first: int, last: int) -> DataFrame:
        return (shared.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"),
                              F.explode(F.slice("heads", first, last - first + 1)).alias("h"))
                .select(F.col("h.id").alias("a"), F.col("h.n_shingles").alias("n"), "b", "m")
                .where("a < b").where(alike).select("a", "b").distinct())

    wanted = nodes.join(shared.select("id").distinct(), "id").select("id", "doc_id", "set_hash")
    sets = written(shingle_sets(docs, wanted, width), "sets")
    links = confirmed(star(1, 1), sets, percent)
    links = written(links.unionByName(of_one_id) if link_ids else links, "links")
    ids = nodes.select("id")
    found = written(ids.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component")),
                    "components")

    def apart(pairs: DataFrame) -> DataFrame:
        return (pairs.join(found.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
                .join(found.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
                .where("ca <> cb").select("a", "b"))

    def widened(pairs: DataFrame) -> DataFrame:
        """The components with the confirmed pairs added: only components that a new link touches are labelled again."""
        more = written(confirmed(pairs, sets, percent), "links")
        if more.isEmpty():
            return found
        between = (more.join(found.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
                   .join(found.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
                   .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = components(between).select(F.col("id").alias("component"), F.col("component").alias("low"))
        return written(found.join(joined, "component", "left").select("id", F.coalesce("low", "component").alias("component")),
                       "components")

    found = widened(apart(star(2, centres)))

    # Buckets with more members than centres, whose members are still in several components.
    large = shared.where(f"size(heads) > {centres}").join(found, "id")
    split = (large.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("band", "key"))
    rest = large.join(split, ["band", "key"]).select("id").distinct()
    found = widened(apart(prefix_pairs(sets.join(rest, "id"), found, percent)))

    labelled = written(classes.join(found, "id").select("set_hash", F.col("component").alias("root"), "doc_id"), "labelled")
    heads = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "set_hash")).alias("head"))
    labelled = labelled.join(heads, "root").select("set_hash", F.col("head.doc_id").alias("component"), F.col("head.set_hash").alias("head"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sketch.join(labelled, "set_hash", "left").select(
        "doc_id", "text_sha256", "set_hash", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        (~linked | ((F.col("doc_id") == F.col("component")) & (F.col("set_hash") == F.col("head")))).alias("stands"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return near_rows(docs, **settings).select("doc_id", "n_shingles", "component_id", "kept").distinct()


def prefix_pairs(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle early enough to be similar.

    With every set in one order (rare shingles first), the first shingle that two sets share bounds their
    intersection by what is left of either set from there on, which must reach the share of both sizes."""
    each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A shingle that occurs once links nothing; it still takes the place of a rare one in the order.
    known = each.join(common, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    placed = (known.select("id", "n", (F.col("n") - F.size("s")).alias("lone"), F.posexplode("s").alias("at", "x"))
              .select("id", "n", "x.shingle", (F.col("n") - F.col("lone") - F.col("at")).alias("left"))
              .where(f"left * 100 >= n * {percent}").join(found, "id"))
    one = placed.select("shingle", F.col("id").alias("a"), F.col("n").alias("n"), F.col("left").alias("l"), F.col("component").alias("ca"))
    two = placed.select("shingle", F.col("id").alias("b"), F.col("n").alias("m"), F.col("left").alias("r"), F.col("component").alias("cb"))
    enough = f"least(l, r) * {100 + percent} >= (n + m) * {percent}"
    return one.join(two, "shingle").where(f"a < b and ca <> cb and {enough}").select("a", "b").distinct()


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stay, once each, with all their columns; of rows that repeat id and set, one text stays.
    Here a document is an id and a set: other texts of an id whose copy goes are not lost with it."""
    kept = (near_rows(docs, link_ids=False, **settings).where("stands").groupBy("doc_id", "set_hash")
            .agg(F.min("text_sha256").alias("digest")))
    return one_of_each(docs, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), kept)
