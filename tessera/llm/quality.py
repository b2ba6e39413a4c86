"""Quality rules: clean line by line, then reject documents that lost too much.

Per line: navigation (many ``|`` separators), shouting and symbol noise
(punctuation rules), one word repeated over and over, boilerplate phrases,
lines without a letter.  Failing lines are removed, blank ones with them: the
cleaned text is the good lines joined by newlines.  A document whose removed
lines hold more than ``max_lost_percent`` of its characters is rejected, and
so is one that fails the base limits (too few words, or too many words in
repeated three-word windows).

All of it is column expressions on one row, so no shuffle is needed and the
work of a document does not depend on any other.  Windows are compared by a
64-bit hash within their document; sorting (hash, position) pairs keeps very
long and very repetitive texts at n log n.

Defined cases: null or empty text has no words and fails the base limits;
ids are never used, so null ids and repeated rows pass through one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_CLASS, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Phrases, in lower case, that mark a short line as boilerplate.
BOILERPLATE = ("cookie policy", "uses cookies", "enable javascript", "all rights reserved", "privacy policy", "terms of use",
               "terms of service", "click here", "read more", "subscribe now", "sign up now", "share this")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50


def _any_phrase(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in BOILERPLATE])


def line_fails(line: Column, boilerplate: Column) -> Column:
    """True when a line is navigation, noise, repetition or boilerplate.
    ``boilerplate`` tells whether the whole text holds any of the phrases at all."""
    words = F.size(F.split(F.btrim(line), SPACE_CLASS + "+"))
    pipes = F.regexp_count(line, F.lit(r"\|"))
    shouts = F.regexp_count(line, F.lit(r"!{2,}"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    different = F.size(F.array_distinct(F.split(F.btrim(line), SPACE_CLASS + "+")))
    return (((pipes >= 3) & (pipes * 4 >= words))
            | ((shouts >= 3) & (shouts * 2 >= words))
            | ((symbols >= 3) & (symbols * 2 >= words))
            | ((words >= 12) & (different * 4 <= words))
            | (boilerplate & (words <= 25) & _any_phrase(line))
            | ~line.rlike(r"\p{L}"))


def quality_columns(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``docs`` reduced to one struct column of all its columns (``row``) plus the measures."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE_CHARS[1:], text)
    df = df.withColumn("has_phrase", _any_phrase(text)).withColumn("words", words_of(spaced, " ")).withColumn(
        "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("word_hash", F.transform("words", lambda w: F.xxhash64(w)))
    wh = F.col("word_hash")
    df = df.withColumn("windows", F.transform(
        F.slice("word_hash", 1, F.greatest(F.size("word_hash") - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(wh, i + 1), F.get(wh, i + 2))))
    df = df.withColumn("sorted_windows", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("sorted_windows")
    df = df.withColumn("places", F.array_sort(F.filter(F.transform(at, lambda x, j: F.when(
        (F.get(at, j - 1)["h"] == x["h"]) | (F.get(at, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))
    places = F.col("places")
    covered = F.aggregate(
        F.transform(places, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(places, j - 1), F.lit(-3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    df = df.withColumn("good_lines", F.filter("lines", lambda x: ~line_fails(x, F.col("has_phrase"))))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.size("lines") - F.size("good_lines")).cast("long").alias("n_removed_lines"),
        chars(F.col("lines")).alias("line_chars"), chars(F.col("good_lines")).alias("good_chars"),
        F.array_join("good_lines", "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * (F.col("line_chars") - F.col("good_chars")) > max_lost_percent * F.col("line_chars")
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def judge_quality(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per input row: doc_id, the base measures, base_failed, kept, and the method's line counts."""
    return quality_columns(docs.select("doc_id", "text"), max_lost_percent).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines")


def cleaned(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per input row: doc_id, clean_text (its good lines), kept, n_removed_lines."""
    return quality_columns(docs.select("doc_id", "text"), max_lost_percent).select(
        "row.doc_id", "clean_text", "kept", "n_removed_lines")


def keep_good(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows whose verdict is to keep, with the cleaned text as ``text``."""
    # A filter here would be pushed below the measures and repeat them; unfolding an array of one row is not.
    judged = quality_columns(docs, max_lost_percent)
    row = F.struct(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return judged.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("row")).select("row.*")
