"""Exact dedup: 128-bit content hash, bytes compared inside groups.

The first pass reduces every text to a narrow row (id, 128-bit hash,
SHA-256, length), written once to the shared folder.  Groups come from that
table with partial aggregation, so a third of all rows in one group costs
one buffer per task.  Only texts of groups with two or more members are
read again: they are grouped by (hash, whole normalised text), again with
partial aggregation, and a hash with two texts is a collision whose rows
are regrouped by the text itself.

Defined cases: null text counts as empty, and empty texts are equal to each
other; rows that repeat both id and normalised text are one document; one
id with two different texts is two documents; a null id sorts after all
others and can be the kept id only of a group without any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, id_and_text, one_of_each, written


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _keepers(rows: DataFrame, *keys: str) -> DataFrame:
    """Per group its size and the id that stays: longest original text, then smallest id."""
    first = F.min(F.struct((-F.col("n_code")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).select(
        *keys, "group_size", F.col("first.doc_id").alias("keep_id"))


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spaceless = id_and_text(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_code"),
        F.translate("text", SPACE_CHARS, "").alias("content"))
    hashed = spaceless.withColumn("hash", content_hash(F.col("content")))
    rows = written(
        hashed.select("doc_id", "n_code", "hash", F.sha2("content", 256).alias("text_sha256"))
        .groupBy("doc_id", "hash", "text_sha256").agg(F.max("n_code").alias("n_code")), "exact")

    groups = _keepers(rows, "hash")
    shared = groups.where("group_size > 1").select("hash")
    members = rows.join(shared, "hash").select("doc_id").distinct()
    texts = hashed.alias("t").join(members.alias("m"), F.expr("t.doc_id <=> m.doc_id"), "left_semi")
    distinct = texts.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"))
    collided = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")

    plain = rows.join(collided, "hash", "left_anti").join(groups, "hash")
    apart = (texts.join(collided, "hash").groupBy("doc_id", "hash", "content")
             .agg(F.max("n_code").alias("n_code")))
    exact = apart.join(_keepers(apart, "hash", "content"), ["hash", "content"]).withColumn(
        "text_sha256", F.sha2("content", 256))
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return plain.select(*out).unionByName(exact.select(*out))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, once each, with all their columns."""
    kept = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    content = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE_CHARS, "")
    return one_of_each(docs, F.sha2(content, 256), kept)
