"""Best-fit packing of tokenized documents into sequences of a fixed length.

Vector best-fit: a sequence has three capacities (tokens, documents and
attention cost, the sum of squared piece lengths).  Pieces go, longest
first, to the sequence that fits under every capacity and whose weighted
residual norm (or dot-product) is best.

Only the count of pieces per length (at most ``capacity`` numbers) decides
the packing, so the driver plans with counts: equal sequences are ranges
(first id, how many, what is left), and a length's pieces fill whole ranges
at a time.  The plan holds runs "pieces number a to b of this length go to
sequences from s on, at this offset", a few per length however many
documents there are.  Every piece then finds its own place from its number
among the pieces of its length: its place within its written partition plus
the partitions before, which are counts again.

Defined cases: null text counts as empty and is one piece with the end id
alone; null ids and repeated rows are packed as documents of their own; no
documents give no rows.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import pieces as P
from tessera.llm.common import id_and_text, literal_table, ship, written

ship(__name__)

REMEMBERED = 400_000
BROADCAST_RUNS = 200_000
_loaded: dict = {}


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention bind no later than the tokens do."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    measure: str = "norm"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in
    order from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _plain_byte_bpe(model: dict) -> bool:
    """Whether a tokenizer's file describes byte-level BPE with the usual split, whose ids are in the order of the merges."""
    bpe, split = model["model"], model.get("pre_tokenizer") or {}
    if bpe["type"] != "BPE" or model.get("normalizer") or model.get("truncation") or model.get("padding") or bpe.get("dropout"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    made = [bpe["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in bpe["merges"]]
    letters = [bpe["vocab"].get(c, -1) for c in _byte_letters()]
    ordered = None not in made and min(letters) >= 0 and all(a < b for a, b in zip([max(letters), *made], made))
    return ordered and len(bpe["vocab"]) == len(made) + 256


def _tokenizer(path: str):
    """The tokenizer, a faster one for the same ids where there is one, and the pieces that the first has met."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        fast = None
        if _plain_byte_bpe(model):
            import tiktoken
            from public_tokenizers import PATTERN

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
            fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = (Tokenizer.from_file(path), fast, {})
    return _loaded[path]


def token_ids(texts: list[str], path: str, special: tuple[str, ...] = ("<|endoftext|>",)):
    """Ids of each text by the tokenizer's file, without its own special tokens added.

    A text that spells out a special token goes through the tokenizer whole, as does every text of a file that is no
    plain byte-level BPE. For the others the same ids come from the same ranks by a faster encoder; it refuses very
    long runs of white space, and then each different piece of the text is merged once."""
    tokenizer, fast, known = _tokenizer(path)

    def to_ids(found: list[str]) -> list[list[int]]:
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in found if p not in known]
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            known.update(zip(part, (e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False))))
        return [known[p] for p in found]

    for text in texts:
        if fast is None or any(s in text for s in special):
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
            continue
        try:
            yield fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            yield next(P.encode_batches([text], to_ids))


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place (part, nth) among the
    pieces of its length in its partition. Written, so that the places stay what they are."""
    def work(frames):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["doc_id"].array, token_ids(frame["text"].tolist(), path)):
                raw = np.append(ids, end_id).astype("<u4")
                cut = list(range(len(raw) % capacity or capacity, len(raw) + 1, capacity)) if len(raw) > capacity else [len(raw)]
                for k, (a, b) in enumerate(zip([0, *cut], cut)):
                    rows.append((doc, k, a, b - a, zlib.crc32(raw[a:b].tobytes()), part, int(met[b - a])))
                    met[b - a] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return written(id_and_text(docs).mapInPandas(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> list[dict]:
    """Runs of pieces: numbers ``a`` to ``b`` (excluded) of ``length``, ``per`` to a sequence,
    go to sequences from ``first`` on at ``offset``."""
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    if counts and (max(counts) > capacity.tokens or max(counts) ** 2 > capacity.attention or capacity.documents < 1):
        raise ValueError("a piece does not fit an empty sequence")
    first, many, left, runs, opened = [], [], np.empty((0, 3)), [], 0

    def take(k: int, per: int, number: int, length: int, at: int, rest: np.ndarray) -> None:
        """``number`` pieces, ``per`` to a sequence, go to range k; what it does not need splits off."""
        need = np.array([length, 1, length * length], float)
        runs.append(dict(length=length, a=at, b=at + number, per=per, first=first[k], offset=int(size[0] - rest[0])))
        full, odd = divmod(number, per)
        split = [(full, rest - per * need), (1 if odd else 0, rest - odd * need), (many[k] - full - bool(odd), rest)]
        begin, new = first[k], []
        for n, what in split:
            if n:
                new.append((begin, n, what))
                begin += n
        first[k], many[k] = new[0][:2]
        nonlocal left
        left[k] = new[0][2]
        for b, n, what in new[1:]:
            first.append(b)
            many.append(n)
            left = np.vstack([left, what])

    for length in sorted(counts, reverse=True):
        need, at, todo = np.array([length, 1, length * length], float), 0, int(counts[length])
        while todo:
            fits = np.flatnonzero((left >= need).all(1))
            if not len(fits):
                per = int((size // need).min())
                bins = -(-todo // per)
                first.append(opened)
                many.append(bins)
                left = np.vstack([left, size])
                opened += bins
                k = len(first) - 1
            else:
                per_bin = left[fits] / size
                if capacity.measure == "norm":
                    score = -(((left[fits] - need) / size) ** 2 @ weights)
                else:
                    score = (per_bin * (need / size)) @ weights
                k = int(fits[score.argmax()])
            per = int((left[k] // need).min())
            number = min(todo, per * many[k])
            take(k, per, number, length, at, left[k].copy())
            at, todo = at + number, todo - number
    return runs


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = cut_pieces(docs, path, capacity.tokens, end_id)
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    runs = plan(counts, capacity)
    table = literal_table(spark, runs, "length long, a long, b long, per long, first long, offset long")
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("b", "a", "per", "first", F.col("offset").alias("at")))).alias("runs"))
    if len(runs) <= BROADCAST_RUNS:
        by_length = F.broadcast(by_length)
    placed = cut.join(base, ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    placed = placed.join(by_length, "length").withColumn(
        "run", F.get(F.filter("runs", lambda r: r["b"] > F.col("number")), F.lit(0)))
    inside = F.col("number") - F.col("run.a")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.expr("(number - run.a) div run.per")).alias("sequence_id"),
        (F.col("run.at") + (inside % F.col("run.per")) * F.col("length")).alias("offset"))
