"""Line dedup: a deletion-neighbourhood join over the lines of all documents.

Lines compare by their trimmed, lower-cased form.  Equal forms are one form,
named by its earliest place (smallest doc_id, then line number, then a 64-bit
hash of the whole text, which tells texts of one id or of null ids apart).  Two forms
of at least ``min_chars`` code points are near when at most ``edits`` edits
(a character replaced, added or left out) turn one into the other.  Both are
parameters of every function: ``edits`` may be 0 (equal lines alone), 1 or 2,
``min_chars`` anything from 1.  With one edit:

* replaced: both, without the character at the same position, are equal.
  All forms that agree in (hash of the variant, position) are one edit apart
  from each other, so each is linked with the earliest of them alone.
* added or left out: the shorter form itself equals a variant of the longer.

So each form emits its variants as hashed keys, equal keys are joined, and
the pairs are verified on the texts.  Most lines have no near form at all,
and that shows without variants: one edit leaves either the first half or
the second half of the shorter form untouched.  Only forms that share a half
with another form emit variants, and only for positions outside that half;
this leaves out nothing.

With two edits, a form emits what is left without two, one or none of its
characters, each with two gaps: places of that variant at which a form may
hold characters more.  A character left out fixes a gap, the others run over
all places.  Forms that agree in (variant, gaps) are all within two edits of
each other, because characters in a common gap replace one another; so each
is again linked with the earliest alone, and nothing is paired inside a group.
Only forms that share one of the three pieces of the shorter form, moved by
two places at most, emit anything.  A form of n characters emits about
2 * n * n rows, in blocks, so a third edit is not offered.

A line is dropped when an earlier line equals it or is near it.

Defined cases: blank lines are never dropped; null or empty text is one
blank line; rows that repeat both id and text are one document; one id with
several texts, or several null ids, are several documents, each with lines of
its own, and the summary adds them up by id; lines of a null id come last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, id_and_text, ship, written

ship(__name__)

#: Defaults of the parameters: the edit bound, and the shortest form that has near forms.
EDITS = 1
MIN_CHARS = 20

#: Two primes below 2**31 and one base: hashes of variants with two edits are pairs of remainders.
PRIMES = (2147483647, 2147483629)
BASE = 1103515245
BLOCK_ROWS = 200_000
_state: dict = {}


def line_form(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, form) of every line that is not blank."""
    split = id_and_text(docs).select("doc_id", _text_key(F.col("text")).alias("text_key"),
                                     F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return split.select("doc_id", "text_key", "line", line_form(F.col("raw")).alias("form")).where("form <> ''")


def _check(edits: int, min_chars: int) -> None:
    if edits not in (0, 1, 2):
        raise ValueError(f"edits must be 0, 1 or 2, not {edits!r}")
    if min_chars < 1:
        raise ValueError(f"min_chars must be at least 1, not {min_chars!r}")


def _halves(form: Column, min_chars: int) -> Column:
    """Hashes of the halves that must agree with a form of the same length, one longer or one shorter."""
    n = F.length(form)
    made = []
    for half in (F.expr("length(form) div 2"), F.expr("(length(form) - 1) div 2")):
        made += [F.struct(F.xxhash64(F.lit("first"), half, F.left(form, half)).alias("half"), F.lit(True).alias("front")),
                 F.struct(F.xxhash64(F.lit("last"), half, F.right(form, half)).alias("half"), F.lit(False).alias("front"))]
    return F.when(n >= min_chars, F.array_distinct(F.array(*made)))


def _thirds(form: Column, min_chars: int) -> Column:
    """Hashes of the pieces of which one at least must agree with a form of up to two characters more or less:
    the thirds that a form of each such length m would have, moved by up to two places."""
    def piece(m: Column, i: Column, shift: Column) -> Column:
        begin = F.floor(m * i / 3).cast("int")
        size = F.floor(m * (i + 1) / 3).cast("int") - begin
        inside = (begin + shift >= 0) & (begin + shift + size <= F.length(form))
        named = F.struct(F.xxhash64(m, i, F.substring(form, begin + shift + 1, size)).alias("half"), F.lit(True).alias("front"))
        return F.when(inside, named)

    n = F.length(form)
    lengths = F.sequence(F.greatest(n - 2, F.lit(1)), n)
    thirds, shifts = F.array(*map(F.lit, range(3))), F.array(*map(F.lit, range(-2, 3)))
    made = F.flatten(F.flatten(F.transform(lengths, lambda m: F.transform(thirds, lambda i: F.transform(
        shifts, lambda s: piece(m, i, s))))))
    return F.when(n >= min_chars, F.array_distinct(F.array_compact(made)))


def _no_pieces(form: Column, min_chars: int) -> Column:
    return F.lit(None).cast("array<struct<half:bigint,front:boolean>>")


#: Edit bound: the pieces by which forms without any near form are left out.
PIECES = {0: _no_pieces, 1: _halves, 2: _thirds}


def _variant_hashes(text: str) -> tuple[int, np.ndarray]:
    """Hash of a text, and of the text without each of its characters, by sums of powers modulo 2**64."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if len(_state.get("powers", ())) < n:
        powers = np.full(max(n, 1 << 16), 0xD1342543DE82EF95, np.uint64)
        powers[0] = 1
        _state["powers"] = np.multiply.accumulate(powers)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _state["powers"][:n])))
    inverse = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    variants = sums[:-1] + (sums[-1] - sums[1:]) * inverse
    return int(sums[-1:].view(np.int64)[0]), variants.view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether at most one character replaced, added or left out turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def within(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` characters replaced, added or left out turn a into b."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b) <= edits
    return edits > 0 and (within(a[1:], b[1:], edits - 1) or within(a, b[1:], edits - 1) or within(a[1:], b, edits - 1))


def _powers(prime: int, n: int) -> np.ndarray:
    """Powers of the base modulo a prime, doubled until there are n."""
    known = _state.get(prime, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate((known, known * np.uint64(pow(BASE, len(known), prime)) % np.uint64(prime)))
    _state[prime] = known
    return known[:n]


def _gapped_keys(text: str):
    """Blocks (keys, gaps) of the variants of a text without two, one or none of its characters, each with all pairs of
    gaps that hold the left out ones.  One block follows from one first character, so blocks are as long as the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums, inverses = [], []
    for prime in PRIMES:
        terms = codes * _powers(prime, n) % np.uint64(prime)
        sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms))) % np.uint64(prime))
        inverses.append(pow(BASE, -1, prime))

    def spans(parts) -> np.ndarray:
        """Key of the characters in the spans [begin, end), of which the k-th has moved k places to the front."""
        halves = []
        for prime, total, inverse in zip(PRIMES, sums, inverses):
            p = np.uint64(prime)
            found = np.uint64(0)
            for k, (begin, end) in enumerate(parts):
                moved = np.uint64(pow(inverse, k, prime))
                found = (found + (total[end] + p - total[begin]) % p * moved) % p
            halves.append(found)
        return ((halves[0] << np.uint64(31)) | halves[1]).view(np.int64)

    def pack(first, second) -> np.ndarray:
        return (np.minimum(first, second).astype(np.int64) << 32) | np.maximum(first, second)

    places = np.arange(n + 1)
    zero = np.zeros(1, np.int64)
    whole = spans([(zero, zero + n)])
    for i in range(n + 1):  # nothing left out
        yield np.broadcast_to(whole, n + 1 - i), pack(np.int64(i), places[i:])
    for i in range(n):  # one character left out; the other gap is anywhere in what is left
        one = spans([(zero, zero + i), (zero + i + 1, zero + n)])
        yield np.broadcast_to(one, n), pack(np.int64(i), places[:n])
    for i in range(n - 1):  # two characters left out
        j = places[i + 1:n]
        yield spans([(zero, zero + i), (zero + i + 1, j), (j + 1, zero + n)]), pack(np.int64(i), j - 1)


def _gapped_variants(forms: DataFrame) -> DataFrame:
    """(key, position, doc_id, text_key, line) of the forms (doc_id, text_key, line, form); position: both gaps."""
    def work(frames):
        for frame in frames:
            for doc, text_key, line, form in zip(frame["doc_id"].array, frame["text_key"], frame["line"], frame["form"]):
                waiting, rows = [], 0
                blocks = _gapped_keys(form)
                while True:
                    block = next(blocks, None)
                    if block is not None:
                        waiting.append(block)
                        rows += len(block[0])
                    if waiting and (block is None or rows >= BLOCK_ROWS):
                        made = pd.DataFrame({"key": np.concatenate([k for k, _ in waiting]),
                                             "position": np.concatenate([g for _, g in waiting]),
                                             "doc_id": doc, "text_key": text_key, "line": line})
                        yield made.drop_duplicates(["key", "position"]).astype({"doc_id": "Int64"})
                        waiting, rows = [], 0
                    if block is None:
                        break

    return forms.select("doc_id", "text_key", "line", "form").mapInPandas(
        work, "key long, position long, doc_id long, text_key long, line int")


def _variants(forms: DataFrame) -> DataFrame:
    """(key, position, doc_id, text_key, line) of the forms (doc_id, text_key, line, form, front, back); position -1: the form itself.
    A form that shares its front with another has its edit behind it, and the other way round."""
    def work(frames):
        for frame in frames:
            parts = []
            columns = zip(frame["doc_id"].array, frame["text_key"], frame["line"], frame["form"], frame["front"], frame["back"])
            for doc, text_key, line, form, front, back in columns:
                whole, variants = _variant_hashes(form)
                n = len(form)
                at = np.arange(n)
                at = at[((at >= (n - 1) // 2) & front) | ((at < n - (n - 1) // 2) & back)]
                parts.append(pd.DataFrame({"key": np.append(variants[at], whole), "position": np.append(at, -1),
                                           "doc_id": doc, "text_key": text_key, "line": line}))
            if parts:
                yield pd.concat(parts, ignore_index=True).astype({"doc_id": "Int64"})

    return forms.mapInPandas(work, "key long, position int, doc_id long, text_key long, line int")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "line", "text_key")


def _one_edit_pairs(texts: DataFrame) -> DataFrame:
    """(later, earlier) places of candidates for one edit."""
    keys = written(_variants(texts).withColumn("place", _place()).select("key", "position", "place"), "variants")

    group = keys.where("position >= 0").groupBy("key", "position").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    replaced = keys.join(group.where("n > 1"), ["key", "position"]).where("first < place").select(
        F.col("place").alias("later"), F.col("first").alias("earlier"))
    whole = keys.where("position < 0").select("key", F.col("place").alias("short"))
    added = keys.where("position >= 0").join(whole, "key").where("place <> short").select(
        F.greatest("place", "short").alias("later"), F.least("place", "short").alias("earlier"))
    return replaced.unionByName(added).distinct()


def _two_edit_pairs(texts: DataFrame) -> DataFrame:
    """(later, earlier) places of candidates for two edits: each form and the earliest of each of its groups."""
    keys = written(_gapped_variants(texts).withColumn("place", _place()).select("key", "position", "place"), "variants")
    group = keys.groupBy("key", "position").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return (keys.join(group.where("first < last").drop("last"), ["key", "position"]).where("first < place")
            .select(F.col("place").alias("later"), F.col("first").alias("earlier")).distinct())


def near_pairs(docs: DataFrame, forms: DataFrame, edits: int = EDITS) -> DataFrame:
    """(later, earlier) places of forms within ``edits`` (1 or 2) edits; for each later one its earliest is among them."""
    halves = forms.where("halves is not null").select("place", F.explode("halves").alias("h")).select("place", "h.*")
    shared = halves.groupBy("half", "front").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half", "front")
    wanted = (halves.join(shared, ["half", "front"]).groupBy("place")
              .agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back")))
    by_doc = wanted.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_key").alias("text_key")).agg(F.collect_list(F.struct(
        F.col("place.line").alias("line"), "front", "back")).alias("wanted"))
    keyed = id_and_text(docs).withColumn("text_key", _text_key(F.col("text")))
    texts = (keyed.alias("d").join(by_doc.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.text_key = w.text_key"))
             .select("d.doc_id", "d.text_key", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
             .where("w.line < size(lines)")
             .select("doc_id", "text_key", "w.*", line_form(F.get("lines", F.col("w.line"))).alias("form")).where("form <> ''")
             .dropDuplicates(["doc_id", "text_key", "line"]))
    texts = written(texts, "near-lines")
    pairs = _one_edit_pairs(texts) if edits == 1 else _two_edit_pairs(texts)
    named = texts.select(_place().alias("place"), "form")
    both = (pairs.join(named.select(F.col("place").alias("later"), F.col("form").alias("a")), "later")
            .join(named.select(F.col("place").alias("earlier"), F.col("form").alias("b")), "earlier"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) if edits == 1 else within(x, y, edits) for x, y in zip(a, b)], dtype=bool)

    return both.where(near("a", "b")).select("later", "earlier")


def _verdicts(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The columns of ``line_verdicts`` and text_key."""
    _check(edits, min_chars)
    hashed = _lines(docs).select("doc_id", "text_key", "line", F.unhex(F.md5(F.col("form").cast("binary"))).alias("hash"),
                                 PIECES[edits](F.col("form"), min_chars).alias("halves"))
    hashed = written(hashed.dropDuplicates(["doc_id", "text_key", "line"]), "lines")
    forms = written(hashed.groupBy("hash").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("n_equal"),
                                               F.any_value("halves").alias("halves")), "forms")
    if edits:
        near = near_pairs(docs, forms, edits).groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("earlier"))
        first = forms.join(near, "place", "left").select("hash", "n_equal", F.coalesce("earlier", "place").alias("first"))
    else:
        first = forms.select("hash", "n_equal", F.col("place").alias("first"))
    here = hashed.join(first, "hash").withColumn("place", _place())
    return here.select("doc_id", "text_key", "line", (F.col("place") == F.col("first")).alias("kept"),
                       F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), "n_equal")


def line_verdicts(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that is not blank: doc_id, line, kept, first_doc_id, first_line (the earliest line that
    equals it or is near it, itself if kept), n_equal (lines of the same form)."""
    return _verdicts(docs, edits, min_chars).drop("text_key")


def line_summary(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per id, over all texts of the id: doc_id, n_lines (not blank), n_kept, dropped (numbers of its dropped
    lines, sorted)."""
    verdicts = _verdicts(docs, edits, min_chars).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("kept").cast("long")).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line")))).alias("dropped"))
    ids = docs.select("doc_id").distinct()
    return ids.alias("d").join(verdicts.alias("v"), F.expr("d.doc_id <=> v.doc_id"), "left").select(
        "d.doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns, with their dropped lines left out of ``text``."""
    gone = (_verdicts(docs, edits, min_chars).where(~F.col("kept")).groupBy("doc_id", "text_key")
            .agg(F.collect_list("line").alias("gone")))
    rest = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    columns = [F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(rest).alias("text") if c == "text"
               else F.col(f"d.`{c}`") for c in docs.columns]
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (_text_key(F.col("d.text")) == F.col("g.text_key"))
    return docs.alias("d").join(gone.alias("g"), same, "left").select(*columns)
