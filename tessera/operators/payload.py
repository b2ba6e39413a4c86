"""Nested JSON payloads as VARIANT columns (F9): fields as typed columns, and a profile of the keys of all rows.

A payload column is parsed once into VARIANT, where malformed text is null.
The profile walks down one level of nesting at a time: every level is an
explode of the objects and lists of the level above, grouped by path and kind
of value with partial aggregation, so however often a key stands in the rows,
one counter per task moves.  There are as many levels as the deepest payload
has.

Defined cases: null payloads are missing, text that is no JSON is malformed;
a payload that is no object or list has no keys; the elements of a list share
the path of the list with ``[]``; a key that holds null counts under the kind
null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def value_kind(value: Column) -> Column:
    """number, text, flag, object, list, null or other (dates and bytes, which JSON text never gives)."""
    name = F.schema_of_variant(value)
    return (F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "list").when(name == "VOID", "null")
            .when(name == "STRING", "text").when(name == "BOOLEAN", "flag")
            .when(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("other"))


def with_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The table with typed columns {name: (path, type)} taken from its payload; null where a payload is malformed,
    has no such path, or holds a value that the type cannot."""
    v = F.try_parse_json(_q(column))
    return df.withColumns({name: F.try_variant_get(v, path, kind) for name, (path, kind) in fields.items()})


def payload_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_missing, n_malformed, and the merged schema of all payloads as text."""
    v = F.try_parse_json(_q(column))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(_q(column).isNull(), 1)).alias("n_missing"),
                  F.count(F.when(_q(column).isNotNull() & v.isNull(), 1)).alias("n_malformed"),
                  F.schema_of_variant_agg(v).alias("schema"))


def payload_keys(df: DataFrame, column: str) -> DataFrame:
    """One row per path and kind of value: path, kind, n (how often it occurs)."""
    spark = df.sparkSession
    level = df.select(F.lit("$").alias("path"), F.try_parse_json(_q(column)).alias("v")).where("v is not null")
    found = []
    while True:
        nested = level.where(value_kind(F.col("v")).isin("object", "list"))
        below = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(
            F.col("key").alias("__key"), F.col("value").alias("__value"))).select(
            F.when(F.col("__key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "__key")).alias("path"),
            F.col("__value").alias("v"))
        level = written(below, "payload-level")
        counts = written(level.groupBy("path", value_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), "payload-keys")
        found.append(counts)
        if counts.where("kind in ('object', 'list')").isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("path", "kind").agg(F.sum("n").alias("n"))
