"""Small helpers shared by the text operators."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: The ASCII white space of the contracts, as a regular-expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """Sends a module's functions to the workers by value, so that executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), so extra columns never clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_of_each(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document, (doc_id, digest of its text), is in ``kept`` (doc_id, digest; each once):
    one row of each, the longest text, with all columns.  Null ids are equal to each other."""
    key = lambda d: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), d)
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.length(F.coalesce("text", F.lit(""))), F.xxhash64(*hashable))
    # Rows are reduced before they are shuffled: a document that is repeated very often costs one buffer per task.
    rows = docs.groupBy(key(digest).alias("key")).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return rows.join(kept.select(key(F.col("digest")).alias("key")), "key").select("row.*")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few given rows as a DataFrame, made by Spark from one JSON literal."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(made).alias("row")).select("row.*")


def words_of(text: Column, separators: str) -> Column:
    """Non-empty parts between runs of ``separators``."""
    return F.filter(F.split(text, f"{separators}+"), lambda w: w != F.lit(""))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; every machine has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)
