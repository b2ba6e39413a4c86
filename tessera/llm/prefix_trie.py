"""Conversation prefix trie: shared beginnings of conversations, screened by a count-min sketch.

Rows are turns; texts stay where they are read and only a SHA-256 of role and
text and the text's length travel.  The digest of a prefix is the sum, over
its turns, of hashes of (depth, turn) in four lanes, so that running sums
give the digest of every prefix of every conversation, and the digest of a
prefix without its last turn is a difference.  Running sums go over ranges of
(conversation, depth), so that a conversation that holds a large share of all
turns is shared out between tasks.

1. Every task counts the digests of its prefixes in a count-min sketch, the
   sketches are added up, and the cells that were met more than once are
   handed to all tasks.  The sketch has at most ``4 * WIDEST`` cells of one
   byte; past about that many prefixes it screens less, and results stay.
2. An estimate of one proves that a prefix stands in one conversation alone.
   Its node is complete where it is read: one member, at most one child, one
   leaf, nothing saved.  Only prefixes that may be shared are shuffled.
3. Those are grouped by depth, digest and last turn.  Two different nodes of
   one depth with the same digest would show as two groups; then everything
   is done again with other hashes.
4. Sums over subtrees need no walk over the tree.  A conversation stands for
   a node when it is the node's smallest member; from some depth on it stands
   for all nodes on its path.  What a node's subtree saves is the text that
   its members repeat: for each member the text from the node's depth up to
   the depth from which it stands for its nodes.  The leaves of a subtree are
   the members that stand for a childless node.  Both are sums over members.

The list of the conversations that end at a node is hashed in order: pieces
of the list are made by ranges of (node, conversation), and one task per node
only feeds them to the hash one after the other.

Defined cases: rows without a conv_id belong to no conversation and are left
out; null role or text counts as empty; a null turn comes first, turns that
tie are ordered by their hash, and repeated rows are turns of their own; no
conversations give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, written
from tessera.operators.ordered import row_numbers, running_sum

ship(__name__)

LANES = [f"c{k}" for k in range(4)]
NODE = ["depth", *LANES]
NARROWEST, WIDEST = 1 << 16, 1 << 24
HASHES = 4
#: Ids that are joined to one piece of a list.
IDS = 4096


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, sha, n_bytes) of every turn that has a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, sha, n_bytes): the turns in order, numbered from 1."""
    hashed = written(turn_rows(conversations), "turn-hashes")  # ranges are sampled first: texts are hashed once
    return row_numbers(hashed, [F.col("turn").asc_nulls_first(), F.col("sha")], ["conv_id"], "at").drop("turn")


def plain_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, sha, n_bytes): the turns of every conversation, and its root at depth 0."""
    turns = written(numbered_turns(conversations), "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("n_turns"))
    own = turns.join(sizes, "conv_id").select("conv_id", F.col("at").cast("long").alias("depth"), "n_turns", "sha", "n_bytes")
    return own.unionByName(_roots(sizes))


def _roots(sizes: DataFrame) -> DataFrame:
    return sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_turns", F.lit(b"").alias("sha"), F.lit(0).cast("long").alias("n_bytes"))


def rebuilt_paths(conversations: DataFrame, modulus: int = 9, family: int = 5) -> DataFrame:
    """As ``plain_paths``, of conversations that begin with turns of their family's first one: conversation c takes the
    first h turns of conversation c - c % family (h = crc32(c) % modulus), then its own turns after its first h."""
    turns = written(numbered_turns(conversations), "turns")
    sizes = written(turns.groupBy("conv_id").agg(F.max("at").alias("own_turns")).select(
        "conv_id", "own_turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).alias("h")), "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own_turns").alias("base_turns"))
    built = sizes.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0))))
    built = written(built.select("conv_id", "base", "h", F.col("lent").cast("long").alias("lent"),
                                 (F.col("lent") + F.greatest(F.col("own_turns") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")), "rebuilt")
    own = turns.join(built, "conv_id").where("at > h").select(
        "conv_id", (F.col("lent") + F.col("at") - F.col("h")).alias("depth"), "n_turns", "sha", "n_bytes")
    first = turns.where(F.col("at") < modulus).withColumnRenamed("conv_id", "base")
    lent = first.join(built, "base").where("at <= lent").select(
        "conv_id", F.col("at").cast("long").alias("depth"), "n_turns", "sha", "n_bytes")
    return own.unionByName(lent).unionByName(_roots(built))


def _lanes(salt: int) -> list[Column]:
    """What a turn adds to the four lanes of a digest; each lane holds 2**31 turns without overflow."""
    made = [F.xxhash64(F.lit(2 * salt + k), F.col("depth"), F.col("sha")) for k in range(2)]
    return [part for h in made for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def _digests(paths: DataFrame, salt: int) -> DataFrame:
    """The paths with the digest of each prefix (c0 to c3) and the bytes up to its end."""
    lanes = paths.select("*", *[lane.alias(f"o{k}") for k, lane in enumerate(_lanes(salt))])
    summed = running_sum(lanes, [F.col("depth")], ["o0", "o1", "o2", "o3", "n_bytes"], ["conv_id"], "to_")
    return summed.select("conv_id", "depth", "n_turns", "sha", "n_bytes", *[F.col(f"to_o{k}").alias(f"c{k}") for k in range(4)],
                         *[f"o{k}" for k in range(4)], F.col("to_n_bytes").alias("upto"))


def _parent(salt: int) -> list[Column]:
    """Depth and digest of a node's parent, from depth, digest and last turn."""
    return [(F.col("depth") - 1).alias("depth"), *[(F.col(c) - lane).alias(c) for c, lane in zip(LANES, _lanes(salt))]]


def cells(depth: np.ndarray, lanes: list[np.ndarray], width: int) -> np.ndarray:
    """Cells of each digest in a sketch of HASHES rows of ``width`` cells (a power of two), rows one after the other."""
    out = np.empty((HASHES, len(depth)), np.int64)
    for k in range(HASHES):
        x = depth.astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for lane in lanes:
            x = (x ^ lane.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        out[k] = ((x >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64) + k * width
    return out


def _columns(batch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def count_min(rows: DataFrame, width: int) -> np.ndarray:
    """Packed bits of the cells that two prefixes or more of ``rows`` (depth, c0 to c3) have met.

    A task counts up to two per cell, in one byte; tasks' sketches are added up block by block, as a stream."""
    block = min(width, 1 << 16)

    def count(batches):
        met = np.zeros(HASHES * width, np.uint8)
        for batch in batches:
            depth, *lanes = _columns(batch, NODE)
            where, n = np.unique(cells(depth, lanes, width), return_counts=True)
            met[where] = np.minimum(met[where] + np.minimum(n, 2), 2)
        for k in np.flatnonzero(met.reshape(-1, block).any(1)).tolist():
            part = met[k * block:(k + 1) * block]
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "met": pa.array([part.tobytes()], pa.binary())})

    def add(batches):
        def done():
            return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "met": pa.array([np.packbits(met > 1).tobytes()], pa.binary())})
        at, met = None, None
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("met").to_pylist()):
                part = np.frombuffer(part, np.uint8)
                if k != at:
                    if at is not None:
                        yield done()
                    at, met = k, part
                else:
                    met = np.minimum(met + part, 2)
        if at is not None:
            yield done()

    parts = rows.select(*NODE).mapInArrow(count, "block int, met binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(HASHES * width // 8, np.uint8)
    for r in parts.mapInArrow(add, "block int, met binary").collect():  # at most HASHES * WIDEST bits
        bits[r["block"] * block // 8:][:block // 8] = np.frombuffer(r["met"], np.uint8)
    return bits


def screened(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """The rows with ``shared`` and ``parent_shared``: whether the prefix, or the one before it, may stand in several
    conversations. False is a proof that it stands in one."""
    given = rows.sparkSession.sparkContext.broadcast(bits)
    kept = [c for c in rows.columns if c not in ("o0", "o1", "o2", "o3")]

    def met(depth, lanes):
        at = cells(depth, lanes, width)
        return ((given.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)

    def work(batches):
        for batch in batches:
            depth, *lanes = _columns(batch, NODE)
            own = _columns(batch, ["o0", "o1", "o2", "o3"])
            shared = met(depth, lanes)
            before = met(depth - 1, [a - b for a, b in zip(lanes, own)]) & (depth > 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(shared.astype(bool)), pa.array(before.astype(bool))],
                                             [*kept, "shared", "parent_shared"])

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(work, ", ".join([*fields, "shared boolean", "parent_shared boolean"]))


def list_digests(members: DataFrame) -> DataFrame:
    """For each node (depth, c0 to c3) of ``members``: ends_sha256, the SHA-256 of its conv_ids in ascending order,
    joined by commas."""
    kind = ", ".join(f"{c} long" for c in NODE)

    def breaks(columns: list[np.ndarray]) -> list[int]:
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return [0, *np.flatnonzero(new).tolist(), len(new)]

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, ids = _columns(batch, NODE), batch.column("conv_id").to_numpy()
            edges = breaks(columns)
            cut = [(a, min(a + IDS, y)) for x, y in zip(edges, edges[1:]) for a in range(x, y, IDS)]
            first = np.array([a for a, _ in cut])
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in columns], pa.array(ids[first]),
                                              pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in cut])], [*NODE, "first", "ids"])

    def feed(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if node != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield table(out)
        if at is not None:
            yield table([(*at, state.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*rows))[:5]], pa.array([r[5] for r in rows])],
                                          [*NODE, "ends_sha256"])

    ranged = members.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    parts = ranged.mapInArrow(pieces, f"{kind}, first long, ids string")
    return (parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
            .mapInArrow(feed, f"{kind}, ends_sha256 string"))


def trie(paths: DataFrame, salt: int = 0) -> DataFrame:
    """One row per node of the trie of ``paths`` (as of ``plain_paths``): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = written(paths, "paths")
    while True:
        rows = written(_digests(paths, salt), "prefixes")
        width = 1 << max(1, 2 * rows.count()).bit_length()
        width = min(max(width, NARROWEST), WIDEST)
        seen = written(screened(rows, count_min(rows, width), width), "screened")
        many, single = seen.where("shared"), seen.where("not shared")
        nodes = written(many.groupBy(*NODE, "sha").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"), F.min(F.col("upto") - F.col("n_bytes")).alias("before")), "nodes")
        if nodes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        salt += 1

    below = nodes.where("depth > 0").select(*_parent(salt)).unionByName(
        single.where("depth > 0 and parent_shared").select(*_parent(salt)))
    children = written(below.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")), "children")
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # From which byte on a conversation stands for its nodes, and whether it stands for a leaf.
    own = seen.groupBy("conv_id").agg(
        F.max("upto").alias("total"), F.min(F.when(~F.col("shared"), F.col("upto") - F.col("n_bytes"))).alias("alone"),
        F.max(~F.col("shared") & (F.col("depth") == F.col("n_turns"))).alias("ends_alone"))
    stands = nodes.groupBy(F.col("rep").alias("conv_id")).agg(
        F.min("before").alias("stands"), F.max(F.col("n_children") == 0).alias("stands_for_leaf"))
    about = own.join(stands, "conv_id", "left").select(
        "conv_id", F.coalesce(F.least("alone", "stands"), "total").alias("cut"),
        (F.col("ends_alone") | F.coalesce("stands_for_leaf", F.lit(False))).cast("long").alias("leaf"))
    sums = many.join(about, "conv_id").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("cut") - F.col("upto") + F.col("n_bytes"), F.lit(0))).alias("saved_tokens"))
    ends = list_digests(many.where("depth = n_turns"))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(sums, NODE).join(ends, NODE, "left").select(
        F.col("rep").alias("conv_id"), F.col("depth").alias("at"), *_parent(salt), F.col("depth").cast("boolean").alias("lookup"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    alone = single.select(
        "conv_id", F.col("depth").alias("at"), *_parent(salt), F.col("parent_shared").alias("lookup"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))

    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = paths.agg(F.min("conv_id")).first()[0]
    every = full.unionByName(alone)
    # Below the root the parent is known; deeper down it is looked up, unless the node's own conversation is alone there too,
    # which also shows by the parent not being among the shared ones.
    near = every.where("at <= 1 or not lookup").select(
        "conv_id", F.col("at").alias("depth"),
        F.when(F.col("at") == 0, F.lit(None)).when(F.col("at") == 1, F.lit(least)).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"), *columns)
    deep = every.where("at > 1 and lookup").join(nodes.select(*NODE, F.col("rep").alias("parent_conv_id")), NODE, "left").select(
        "conv_id", F.col("at").alias("depth"), F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), *columns)
    return near.unionByName(deep)
