"""License scans: word k-gram votes on diagonals, merged and verified.

Every rolling word pair of every text is hashed and joined to the pairs of
the templates.  A hit at word p of the text and word t of a template votes
for the diagonal p - t, once the words themselves are equal too.  A phrase
stands at word d exactly when diagonal d holds a vote for each of its pairs.
For longer templates, neighbouring diagonals (a word inserted or left out
moves the rest by one) are merged, and the template is found when enough of
its pairs are seen within a stretch not much longer than the template,
anywhere along the merged diagonals.

The pairs table is bounded by the templates given, which are counted before
it is broadcast; beyond the bound the join is left to the planner.  Texts
never leave their task: one narrow row per hit, plus one per document that
carries its word count, are shuffled.

Defined cases: null text counts as empty (no words, no labels, score 0);
rows are told apart by their place in the scan, so null ids and repeated
rows give one result each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import literal_table, words_of, written

#: Separators of words: ASCII characters that are no letter and no digit (upper case counts as letters here,
#: the text is lower-cased).
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BROADCAST_WORDS = 200_000


@dataclass(frozen=True)
class Template:
    """``exact``: a phrase whose words must stand consecutively; else a text found approximately."""

    label: str
    text: str
    exact: bool = False
    base: bool = False


#: The base phrases.
BASE_PHRASES = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
)

#: The method's own templates.
METHOD_TEMPLATES = (
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files to deal in the software without restriction"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as "
                    "published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _pairs(words: Column, pair_hash: Callable[[Column, Column], Column]) -> Column:
    """Neighbouring words with a hash of them, by position."""
    def pair(word: Column, i: Column) -> Column:
        following = F.get(words, i + 1)
        return F.struct(pair_hash(word, following).alias("pair"), word.alias("one"), following.alias("two"))
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), pair)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE_PHRASES + METHOD_TEMPLATES,
                  min_share: float = 0.8, gap: int = 2,
                  pair_hash: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``min_share`` of a longer template's word pairs must be seen, on diagonals
    chained at most ``gap`` apart, within 1.5 times its length."""
    spark = docs.sparkSession
    rows = [dict(template=i, label=t.label, exact=t.exact, base=t.base, text=t.text) for i, t in enumerate(templates)]
    known = literal_table(spark, rows, "template int, label string, exact boolean, base boolean, text string")
    known = known.withColumn("words", F.split("text", " ")).withColumn("n_pairs", F.size("words") - 1)
    index = known.select("template", "label", "exact", "base", "n_pairs",
                         F.posexplode(_pairs(F.col("words"), pair_hash)).alias("place", "p")).select(
        "template", "label", "exact", "base", "n_pairs", "place", "p.*")
    # The row that carries a document's word count meets a row of the index of its own.
    count_row = literal_table(spark, [dict(template=-1, n_pairs=0, place=-1, pair=0, one="", two="")],
                              "template int, label string, exact boolean, base boolean, n_pairs int, place int, pair long, one string, two string")
    index = index.unionByName(count_row)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_WORDS:
        index = F.broadcast(index)

    texts = docs.select("doc_id", words_of(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), NO_WORD).alias("words"))
    none = F.struct(F.lit(0).cast("long").alias("pair"), F.lit("").alias("one"), F.lit("").alias("two"))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
                         F.concat(F.array(none), _pairs(F.col("words"), pair_hash)).alias("pairs"))
    rolled = texts.select("row", "doc_id", "n_words", F.posexplode("pairs").alias("at", "p")).select(
        "row", "doc_id", "n_words", (F.col("at") - 1).cast("long").alias("word"), "p.*")
    # Equal hashes fetch candidates; a hit is two words that are those of the template.
    hits = rolled.join(index, ["pair", "one", "two"]).where((F.col("word") < 0) == (F.col("template") < 0))

    spot = ["row", "doc_id", "n_words", "template", "label", "exact", "base", "n_pairs"]
    diagonals = hits.groupBy(*spot, (F.col("word") - F.col("place")).alias("diagonal")).agg(
        F.collect_set(F.struct("word", "place")).alias("hits"), F.min("word").alias("first"))
    whole = F.col("exact") & (F.size("hits") == F.col("n_pairs"))
    # Both branches below see the same rows: places in the scan number the documents.
    diagonals = written(diagonals.where((F.col("template") < 0) | whole | ~F.col("exact")), "diagonals")
    settled = diagonals.where("template < 0 or exact").select(
        "row", "doc_id", "n_words", "label", "base", "first", F.when(F.col("template") >= 0, F.lit(1.0)).alias("share"))

    # Longer templates: neighbouring diagonals are one chain, and somewhere along the chain enough of the template's pairs
    # stand within a stretch not much longer than it. A chain that goes on behind the template loses nothing.
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    starts = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    chains = (diagonals.where("template >= 0 and not exact").withColumn("starts", starts.cast("int"))
              .withColumn("chain", F.sum("starts").over(along))
              .groupBy(*spot, "chain").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    places = F.size(F.array_distinct(F.transform("hits", lambda h: h["place"])))
    seen = chains.where(places >= min_share * F.col("n_pairs")).select(*spot, "chain", F.explode("hits").alias("h")).select(
        *spot, "chain", "h.*")
    longest = max([len(t.text.split()) for t in templates if not t.exact], default=0)
    ahead = Window.partitionBy("row", "template", "chain").orderBy("word").rangeBetween(0, 2 * longest)
    near = F.filter(F.collect_set(F.struct("word", "place")).over(ahead), lambda h: h["word"] - F.col("word") <= 1.5 * F.col("n_pairs"))
    shares = seen.withColumn("share", F.size(F.array_distinct(F.transform(near, lambda h: h["place"]))) / F.col("n_pairs"))
    verified = shares.groupBy(*spot, "chain").agg(F.max("share").alias("share"), F.min("word").alias("first")).where(
        F.col("share") >= min_share).select("row", "doc_id", "n_words", "label", "base", "first", "share")

    found = settled.unionByName(verified)
    at_base = F.when(F.col("base"), F.col("first"))
    labels = lambda wanted: F.array_join(F.array_sort(F.collect_set(wanted)), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(at_base).alias("n_base"), F.min(at_base).alias("first_word"), F.max(at_base).alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score")).drop("row")
