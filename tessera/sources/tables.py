"""Scans, discovery, sinks and previews.

Parquet is the default format.  CSV is read with a header row; an explicit
schema avoids the inference pass (which reads the whole file once more).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import NA_TOKENS

ALLOWED_EXTENSIONS = (".parquet", ".csv", ".tsv", ".json")


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in ALLOWED_EXTENSIONS:
        raise ValueError(f"unsupported source extension {ext!r} for {path}")
    return {"tsv": "csv"}.get(ext[1:], ext[1:])


def normalise_nulls(df: DataFrame, na_tokens=NA_TOKENS) -> DataFrame:
    """Missing markers in text columns and NaN in floating columns become null.

    Spark's ``count`` counts NaN and ``max`` returns it, so this runs at load.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType) and na_tokens:
            c = F.when(F.trim(c).isin(list(na_tokens)), F.lit(None)).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, normalise: bool = True,
               limit: int | None = None, multiline: bool = False) -> DataFrame:
    """Load a table.  ``limit`` is an optional row cap (default: all rows)."""
    kind = _format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        sep = "\t" if path.lower().endswith(".tsv") else ","
        df = reader.options(header=True, inferSchema=schema is None, multiLine=multiline,
                            sep=sep, mode="PERMISSIVE").csv(path)
    elif kind == "json":
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    if normalise:
        df = normalise_nulls(df, NA_TOKENS if kind == "csv" else ())
    if limit is not None:
        df = df.limit(int(limit))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                inputs: tuple[str, ...] = ()) -> str:
    """Write a result table; refuses to overwrite one of its own inputs."""
    norm = os.path.normpath(path)
    if any(os.path.normpath(p) == norm for p in inputs):
        raise ValueError("refusing to overwrite an input of this plan: " + path)
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_tables(spark: SparkSession, directory: str) -> list[tuple[int, str, str]]:
    """S3: (index, name, path) of the tables in a directory (metadata only).

    Uses the cluster file system API, so it works for any shared store.
    """
    fs, p = _fs(spark, directory)
    found = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        base, ext = os.path.splitext(name)
        if ext.lower() in ALLOWED_EXTENSIONS and not name.startswith(("_", ".")):
            found.append((base, st.getPath().toString()))
    found.sort()
    return [(i, n, pth) for i, (n, pth) in enumerate(found)]


def load_by_name_or_index(spark: SparkSession, directory: str, key: str | int) -> DataFrame:
    """S3: load one table of a directory by name or position."""
    tables = list_tables(spark, directory)
    for i, n, pth in tables:
        if (isinstance(key, int) and i == key) or n == key:
            return read_table(spark, pth)
    raise KeyError(f"no table {key!r} in {directory}")


def table_info(spark: SparkSession, directory: str, names: list[str] | None = None) -> DataFrame:
    """One row per table — index, name, rows, columns, bytes.

    Row counts come from Parquet footers; byte sizes from the scan's file
    metadata.  The per-table rows are unioned into one plan.
    """
    parts = []
    is_multi = None
    tables = list_tables(spark, directory)
    is_multi = len(tables) > 1
    for i, n, pth in tables:
        if names is not None and n not in names:
            continue
        df = read_table(spark, pth, normalise=False)
        cols = df.columns
        size = source_size(df).first()["size_bytes"]          # one number per table
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).cast("bigint").alias("table_index"), F.lit(n).alias("table_name"),
            F.col("n_rows"), F.lit(len(cols)).cast("bigint").alias("n_columns"),
            F.lit(",".join(cols)).alias("column_names"), F.lit(size).cast("bigint").alias("size_bytes"),
            F.lit(is_multi).alias("is_multi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_size(df: DataFrame) -> DataFrame:
    """Total bytes of the files behind a file-source DataFrame (one row), from the listing of the files; their
    contents are not read."""
    files = df.inputFiles()
    if not files:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("size_bytes"))
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length")
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("size_bytes"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of records (Parquet answers from footers)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows by an explicit order (Spark has no file order); NaN -> null."""
    out = df.orderBy(*order_by).limit(n)
    return normalise_nulls(out, ())


def display_preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """``n`` rows, every cell as text, null shown as empty text."""
    rows = df.orderBy(*order_by).limit(n)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in df.columns])


def long_form(sections: dict[str, DataFrame], key_col: str) -> DataFrame:
    """Union result tables into (section, key, value) text rows.

    Every non-key column of each table becomes one row per input row.
    """
    out = None
    for sec, df in sections.items():
        vals = [c for c in df.columns if c != key_col]
        entries = F.explode(F.array(*[
            F.struct(F.lit(v).alias("metric"), F.col(v).cast("string").alias("value"))
            for v in vals]))
        part = df.select(F.col(key_col).cast("string").alias("k"), entries.alias("e")).select(
            F.lit(sec).alias("section"),
            F.concat_ws(".", F.col("k"), F.col("e.metric")).alias("key"),
            F.col("e.value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
