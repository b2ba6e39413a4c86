"""Type classes and schema-level helpers.

These only read ``df.schema`` — no job is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
STRING = "string"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, T.NumericType):
        return NUMERIC
    if isinstance(dt, T.StringType):
        return STRING
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    """Column names whose type class is one of ``kinds``, in schema order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def select_kind(df: DataFrame, *kinds: str) -> DataFrame:
    """Project the columns of the given type classes."""
    return df.select(*columns_of_kind(df, *kinds))


def dtype_name(dt: T.DataType) -> str:
    """Name shown in profiles: Spark's own simple type string."""
    return dt.simpleString()


# Identifier-like names never used as features (case-insensitive).
ID_LIKE_NAMES = ("id", "customerid", "customer_id", "index", "row_number")


def project_features(df: DataFrame, features: list[str] | None, target: str | None = None,
                     exclude_ids: bool = True) -> DataFrame:
    """Keep the chosen feature list (absent names ignored, matched
    case-insensitively); all non-target columns when none are valid.
    The target column, when given and present, is kept last."""
    lower = {c.lower(): c for c in df.columns}
    tgt = lower.get(target.lower()) if target else None
    banned = {tgt.lower()} if tgt else set()
    if exclude_ids:
        banned |= set(ID_LIKE_NAMES)
    chosen = []
    for f in features or []:
        c = lower.get(f.lower())
        if c and c.lower() not in banned and c not in chosen:
            chosen.append(c)
    if not chosen:
        chosen = [c for c in df.columns if c.lower() not in banned]
    if tgt:
        chosen.append(tgt)
    return df.select(*chosen)


def validate_types(df: DataFrame, expected: dict[str, str]) -> list[dict]:
    """Compare the schema with expected simple type names.

    Returns rows (column, expected, actual, problem) for missing and
    mismatching columns; metadata only, so a plain list.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for col, exp in expected.items():
        if col not in actual:
            out.append({"column": col, "expected": exp, "actual": None, "problem": "missing"})
        elif actual[col] != exp:
            out.append({"column": col, "expected": exp, "actual": actual[col], "problem": "mismatch"})
    return out
