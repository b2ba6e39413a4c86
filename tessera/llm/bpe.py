"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece starts as one node per byte.  The segment tree over the positions
holds, for each live node, the rank of the pair it forms with its right
neighbour; every inner node stores the leftmost minimum of its range.  A
merge takes the root's position, joins the pair, unlinks the right node and
updates three leaves (the joined node, its left neighbour, the dead one),
each in logarithmic time, so a piece of n bytes costs n log n even when it
is very long.

Short pieces, which are nearly all, run the same steps for thousands of
pieces at once: one row of a numpy matrix is one tree.  Different pieces of
a batch are encoded once, and a bounded table remembers them in the worker.

Defined cases: null text counts as empty (no ids, empty digests over
nothing); null ids and repeated rows pass through one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm import pieces as P
from tessera.llm.common import id_and_text, ship

ship(__name__)

NEVER = 1 << 30
#: Pieces up to this many bytes are encoded many at a time.
WIDE = 64
REMEMBERED = 400_000
_loaded: dict = {}


class Ranks:
    """The vocabulary, by rank, and the pairs of tokens that merge."""

    def __init__(self, lines: list[bytes]):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), NEVER)
        self.decimal = [str(i) for i in range(len(self.token))]
        self.known: dict[str, list[int]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NEVER where it does not merge or a side is missing (negative)."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        found = np.where(self.keys[at] == key, self.merged[at], NEVER)
        return np.where((left >= 0) & (right >= 0), found, NEVER)


def load_ranks(path: str) -> Ranks:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Ranks(f.read().splitlines())
    return _loaded[path]


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece, by a segment tree over its byte positions."""
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    ids = [int(ranks.byte[b]) for b in piece]
    pairs = ranks.pairs
    # A leaf is rank * size + position, so the smallest is the leftmost of the lowest rank.
    tree = [NEVER * size] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pairs.get(ids[i] << 20 | ids[i + 1], NEVER) * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank * size + i
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    while tree[1] < NEVER * size and n > 1:
        rank, i = divmod(tree[1], size)
        j = following[i]
        after, before = following[j], previous[i]
        ids[i], following[i] = rank, after
        ids[j] = -1
        put(j, NEVER)
        put(i, pairs.get(rank << 20 | ids[after], NEVER) if after < n else NEVER)
        if after < n:
            previous[after] = i
        if before >= 0:
            put(before, pairs.get(ids[before] << 20 | rank, NEVER))
    return [x for x in ids if x >= 0]


def merge_many(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of many pieces of at most WIDE bytes; row r of every matrix belongs to piece r."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << max(1, int(length.max() - 1).bit_length())
    depth = width.bit_length() - 1
    rows = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    place = np.arange(width)
    live = place < length[:, None]
    ids = np.where(live, ranks.byte[raw], -1)
    following = np.broadcast_to(place + 1, ids.shape).copy()
    previous = np.broadcast_to(place - 1, ids.shape).copy()
    tree = np.full((rows, 2 * width), NEVER * width, np.int64)
    right = np.full(ids.shape, -1, np.int64)
    right[:, :-1] = ids[:, 1:]
    tree[:, width:] = ranks.pair_ranks(ids, right) * width + place
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(r, i, rank):
        k = width + i
        tree[r, k] = rank * width + i
        for _ in range(depth):
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    r = np.flatnonzero(tree[:, 1] < NEVER * width)
    while len(r):
        rank, i = np.divmod(tree[r, 1], width)
        j = following[r, i]
        after, before = following[r, j], previous[r, i]
        ids[r, i], ids[r, j] = rank, -1
        following[r, i] = after
        inside = after < width
        next_id = np.where(inside, ids[r, np.minimum(after, width - 1)], -1)
        put(r, j, np.full(len(r), NEVER))
        put(r, i, ranks.pair_ranks(rank, next_id))
        previous[r[inside], after[inside]] = i[inside]
        has = before >= 0
        rb, b = r[has], before[has]
        put(rb, b, ranks.pair_ranks(ids[rb, b], rank[has]))
        r = r[tree[r, 1] < NEVER * width]
    kept = ids >= 0
    flat, at = ids[kept].tolist(), np.concatenate(([0], np.cumsum(kept.sum(1)))).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def encode_pieces(pieces: list[str], ranks: Ranks) -> list[list[int]]:
    """Ids of each piece: a piece that is a token is that token, others are merged."""
    known = ranks.known
    if len(known) > REMEMBERED:
        known.clear()
    todo: dict[int, list[tuple[str, bytes]]] = {}
    own = {}
    for p in pieces:
        if p not in known:
            raw = p.encode()
            if (whole := ranks.rank.get(raw)) is not None:
                known[p] = [whole]
            elif len(raw) > WIDE:
                own[p] = merge_long(raw, ranks)
            else:
                todo.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
    for group in todo.values():
        for k in range(0, len(group), 8192):
            part = group[k:k + 8192]
            known.update(zip((p for p, _ in part), merge_many([raw for _, raw in part], ranks)))
    return [own[p] if p in own else known[p] for p in pieces]


def encode_texts(texts: list[str], ranks: Ranks) -> Iterator[np.ndarray]:
    """Ids of each text, in order."""
    return P.encode_batches(texts, lambda found: encode_pieces(found, ranks))


def encode_one(text: str, ranks: Ranks) -> np.ndarray:
    """Ids of one text without the batch's piece hashes: every piece on its own."""
    codes = np.frombuffer((text + "\x00").encode("utf-32-le"), np.uint32).copy()
    codes[-1] = 0x110000
    cut = np.flatnonzero(P.piece_starts(codes, P._classes()[codes])).tolist()
    made = encode_pieces([text[a:b] for a, b in zip(cut, cut[1:])], ranks)
    return np.array([i for ids in made for i in ids], np.int64)


def decode_ids(ids: np.ndarray, ranks: Ranks) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(ranks.token.__getitem__, ids.tolist()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` names the rank file, which every worker reads.  Encoded ids are
    decoded again; should two pieces of a batch share a hash, the decoded
    bytes differ from the text and it is encoded piece by piece."""
    def work(frames):
        ranks = load_ranks(path)
        for frame in frames:
            texts = frame["text"].tolist()
            rows = []
            for text, ids in zip(texts, encode_texts(texts, ranks)):
                decoded = decode_ids(ids, ranks)
                if decoded != text.encode():
                    ids = encode_one(text, ranks)
                    decoded = decode_ids(ids, ranks)
                line = " ".join(map(ranks.decimal.__getitem__, ids.tolist()))
                rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return id_and_text(docs).mapInPandas(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id and its ids."""
    def work(frames):
        ranks = load_ranks(path)
        for frame in frames:
            ids = [x.tolist() for x in encode_texts(frame["text"].tolist(), ranks)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "ids": ids})

    return id_and_text(docs).mapInPandas(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """One row per input row (doc_id, ids): doc_id and the bytes that the ids stand for."""
    def work(frames):
        ranks = load_ranks(path)
        for frame in frames:
            made = [decode_ids(np.asarray(x if x is not None else [], np.int64), ranks) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "bytes": made})

    return encoded.select("doc_id", "ids").mapInPandas(work, "doc_id long, bytes binary")
