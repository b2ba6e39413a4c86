"""Queries for sources, profiles and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import stable_round as sround
from tessera.operators import profile as prof
from tessera.plans.registry import load, query, round_doubles
from tessera.session import scratch_path
from tessera.sources import tables as src

# (column, Spark simple type, kind) of the tables profiled by the oracles.
ORDERS_COLS = [("o_orderkey", "bigint", "num"), ("o_custkey", "bigint", "num"),
               ("o_orderstatus", "string", "str"), ("o_totalprice", "double", "num"),
               ("o_orderdate", "timestamp_ntz", "dt"), ("o_orderpriority", "string", "str")]
CUSTOMER_COLS = [("c_custkey", "bigint", "num"), ("c_name", "string", "str"),
                 ("c_nationkey", "int", "num"), ("c_acctbal", "double", "num"),
                 ("c_mktsegment", "string", "str")]
PART_COLS = [("p_partkey", "bigint", "num"), ("p_name", "string", "str"),
             ("p_brand", "string", "str"), ("p_type", "string", "str"),
             ("p_size", "int", "num"), ("p_retailprice", "double", "num")]
SUPPLIER_COLS = [("s_suppkey", "bigint", "num"), ("s_name", "string", "str"),
                 ("s_nationkey", "int", "num"), ("s_acctbal", "double", "num")]
NATION_COLS = [("n_nationkey", "int", "num"), ("n_name", "string", "str"),
               ("n_regionkey", "int", "num")]
REGION_COLS = [("r_regionkey", "int", "num"), ("r_name", "string", "str")]


def profile_sql(table: str, cols, source: str | None = None, string_minmax: bool = False,
                table_col: bool = False) -> str:
    src_ = source or table
    parts = []
    for i, (c, dt, kind) in enumerate(cols):
        mm = kind in ("num", "dt") or (string_minmax and kind == "str")
        parts.append(
            "SELECT " + (f"'{table}' AS table_name, " if table_col else "") +
            f"{i} AS position, '{c}' AS column_name, '{dt}' AS dtype, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"round((CASE WHEN count(*) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*) "
            f"ELSE 0 END) + sign((CASE WHEN count(*) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*) "
            f"ELSE 0 END)) * 1e-5, 2) AS null_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, "
            + (f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
               if mm else "CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value, ")
            + (f"round((avg({c})) + sign((avg({c}))) * 1e-9, 6) AS mean_value, " if kind == "num"
               else "CAST(NULL AS DOUBLE) AS mean_value, ")
            + f"count(*) AS row_count FROM {src_}")
    return "\nUNION ALL\n".join(parts)


@query("profile_orders", profile_sql("orders", ORDERS_COLS), headline=True)
def profile_orders(spark, d):
    """A1: column profile of orders (one aggregation + narrow distinct counts)."""
    return round_doubles(prof.profile(load(spark, d, "orders")))


_ALL = {"region": REGION_COLS, "nation": NATION_COLS, "customer": CUSTOMER_COLS,
        "supplier": SUPPLIER_COLS, "part": PART_COLS, "orders": ORDERS_COLS}


@query("profile_all_tables", "\nUNION ALL\n".join(
    profile_sql(t, c, table_col=True) for t, c in _ALL.items()))
def profile_all_tables(spark, d):
    """Profiles of all scalar tables in one plan, with a table column."""
    return round_doubles(prof.profile_tables({t: load(spark, d, t) for t in _ALL}))


@query("profile_strings_customer", profile_sql("customer", CUSTOMER_COLS, string_minmax=True))
def profile_strings_customer(spark, d):
    """A3: upload-time variant with text min/max."""
    return round_doubles(prof.profile(load(spark, d, "customer"), string_minmax=True))


_SAMPLE_SQL = """
WITH long AS (
  {unions}
), d AS (SELECT DISTINCT column_name, v FROM long WHERE v IS NOT NULL),
r AS (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS rn FROM d)
SELECT column_name, list_sort(list(v)) AS sample_values FROM r WHERE rn <= 5 GROUP BY column_name
"""


@query("sample_values_part", _SAMPLE_SQL.format(unions="\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM part" for c, _, _ in PART_COLS)))
def sample_values_part(spark, d):
    """A2: first five distinct values per column (text order)."""
    return prof.sample_values(load(spark, d, "part"))


@query("first_values_orders", """
WITH h AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders
           ORDER BY o_orderdate, o_orderkey LIMIT 5),
l AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, pos, CAST({c} AS VARCHAR) AS v FROM h"
                              for c, _, _ in ORDERS_COLS) + """)
SELECT column_name, list(v ORDER BY pos) AS sample_values FROM l GROUP BY 1""")
def first_values_orders(spark, d):
    """A3: values of the first five rows by an explicit order (duplicates kept)."""
    return prof.first_values(load(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 5)


@query("row_count_lineitem", "SELECT count(*) AS n_rows FROM lineitem")
def row_count_lineitem(spark, d):
    """Number of records (answered from Parquet footers)."""
    return src.row_count(load(spark, d, "lineitem"))


@query("preview_orders", """
SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10""")
def preview_orders(spark, d):
    """Top-10 preview by an explicit order (the limit is the feature)."""
    return src.preview(load(spark, d, "orders"), 10, ["o_orderdate", "o_orderkey"])


@query("display_preview_customer", """
SELECT coalesce(CAST(c_custkey AS VARCHAR), '') AS c_custkey, coalesce(c_name, '') AS c_name,
       coalesce(CAST(c_nationkey AS VARCHAR), '') AS c_nationkey,
       coalesce(CAST(c_acctbal AS VARCHAR), '') AS c_acctbal,
       coalesce(c_mktsegment, '') AS c_mktsegment
FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) t""")
def display_preview_customer(spark, d):
    """Five rows as text, null as empty text."""
    return src.display_preview(load(spark, d, "customer"), 5, [F.desc("c_acctbal"), "c_custkey"])


@query("csv_roundtrip", "SELECT * FROM part")
def csv_roundtrip(spark, d):
    """Write part as CSV into the shared folder, read it back with the
    known schema (no inference pass) and missing-marker normalisation."""
    part = load(spark, d, "part")
    path = scratch_path(spark, "part-csv")
    src.write_table(part, path, fmt="csv", inputs=(f"{d}/part.parquet",))
    return src.read_table(spark, path, fmt="csv", schema=part.schema)


@query("discover_tables")
def discover_tables(spark, d):
    """Every table of the directory with rows, columns and bytes."""
    return src.table_info(spark, d)


@query("source_size_lineitem")
def source_size_lineitem(spark, d):
    """Bytes behind the lineitem scan."""
    return src.source_size(load(spark, d, "lineitem"))


def _events_with_nulls(spark, d):
    """events with nulls injected (the driver tables hold none): value on
    every 7th event, event_type on every 11th, props on every 13th."""
    ev = load(spark, d, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("props")).alias("props"))


EVENTS_NULLS_SQL = """
SELECT event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS props
FROM events"""


@query("null_report", f"""
WITH e AS ({EVENTS_NULLS_SQL}), p AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
                      f"round((CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*)) + sign((CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*))) * 1e-5, 2) AS null_pct FROM e"
                      for c in ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props'))})
SELECT column_name, null_count, null_pct, null_pct > 30 AS high_nulls FROM p""")
def null_report(spark, d):
    """Null share per column, flagged above 30 %."""
    return prof.null_ranking(prof.profile(_events_with_nulls(spark, d)))


@query("drop_high_null", """
WITH e AS (SELECT event_id, ts, user_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 3 <> 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS props FROM events)
SELECT event_id, ts, user_id, value, props FROM e WHERE value IS NOT NULL""")
def drop_high_null(spark, d):
    """P4 + P5: drop columns over 50 % null (event_type is two-thirds null
    here), then drop rows whose value is null."""
    from tessera.operators.prepare import drop_high_null_columns
    ev = load(spark, d, "events").select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 3 != 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("props")).alias("props"))
    kept = drop_high_null_columns(ev, threshold=0.5)
    return kept.dropna(subset=["value"])


@query("select_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""")
def select_numeric(spark, d):
    """Project the numeric columns of a table (schema only, pruned scan)."""
    from tessera.functions.types import NUMERIC, select_kind
    return select_kind(load(spark, d, "lineitem"), NUMERIC)


@query("project_features", """
SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders""")
def project_features(spark, d):
    """A chosen feature list matched case-insensitively, absent names
    and identifier-like names ignored, the target kept last."""
    from tessera.functions.types import project_features as pf
    return pf(load(spark, d, "orders"), ["O_TOTALPRICE", "o_orderpriority", "no_such_column", "id"],
              target="o_orderstatus")


@query("long_export", """
WITH m AS (SELECT l_returnflag AS k, count(*) AS n_rows, round((avg(l_extendedprice)) + sign((avg(l_extendedprice))) * 1e-9, 6) AS mean_price
           FROM lineitem GROUP BY 1),
p AS (SELECT o_orderpriority AS k, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT 'lineitem_by_flag' AS section, k || '.n_rows' AS key, CAST(n_rows AS VARCHAR) AS value FROM m
UNION ALL SELECT 'lineitem_by_flag', k || '.mean_price', CAST(mean_price AS VARCHAR) FROM m
UNION ALL SELECT 'orders_by_priority', k || '.n_rows', CAST(n_rows AS VARCHAR) FROM p""")
def long_export(spark, d):
    """Result tables unioned into (section, key, value) text rows."""
    li = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(
        F.count(F.lit(1)).alias("n_rows"), sround(F.avg("l_extendedprice"), 6).alias("mean_price"))
    od = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return src.long_form({"lineitem_by_flag": li, "orders_by_priority": od}, "k")
