"""Queries for key detection, joins and join sizes."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import merge as mg
from tessera.operators import profile as prof
from tessera.plans.q_ingest import CUSTOMER_COLS, NATION_COLS, ORDERS_COLS, REGION_COLS
from tessera.plans.registry import load, query, round_doubles

_DETECT = {"orders": ORDERS_COLS, "customer": CUSTOMER_COLS, "nation": NATION_COLS,
           "region": REGION_COLS}


def _tokens(column: str) -> set[str]:
    return set(re.findall(r"[^\s_-]+", column.lower()))


def _detect_sql() -> str:
    """DuckDB twin of key detection.  Candidate pairs depend on names only."""
    parts = []
    pid = 0
    for ta, tb in combinations(_DETECT, 2):
        for ca, ka, _ in _DETECT[ta]:
            for cb, kb, _ in _DETECT[tb]:
                s = len(_tokens(ca) & _tokens(cb)) / len(_tokens(ca) | _tokens(cb))
                if s < 0.3:
                    continue
                num = {"int", "bigint", "double"}
                text = (ka in num) != (kb in num)
                va = f"CAST({ca} AS VARCHAR)" if text else ca
                vb = f"CAST({cb} AS VARCHAR)" if text else cb
                parts.append(f"""SELECT {pid} AS plan_id, '{ta}' AS left_table, '{ca}' AS left_key,
  '{tb}' AS right_table, '{cb}' AS right_key, CAST({s!r} AS DOUBLE) AS name_similarity,
  (SELECT count(DISTINCT {ca}) FROM {ta}) AS ld, (SELECT count(*) FROM {ta}) AS lr,
  (SELECT count(DISTINCT {cb}) FROM {tb}) AS rd, (SELECT count(*) FROM {tb}) AS rr,
  (SELECT count(*) FROM (SELECT DISTINCT {va} AS v FROM {ta} WHERE {ca} IS NOT NULL
                         INTERSECT SELECT DISTINCT {vb} AS v FROM {tb} WHERE {cb} IS NOT NULL)) AS nc""")
                pid += 1
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}),
m AS (SELECT *, CASE WHEN least(ld, rd) > 0 THEN nc / least(ld, rd) ELSE 0 END AS ov,
             ld / greatest(lr, 1) AS ul, rd / greatest(rr, 1) AS ur FROM s)
SELECT plan_id, left_table, left_key, right_table, right_key, round((name_similarity) + sign((name_similarity)) * 1e-9, 6) AS name_similarity,
  CASE WHEN ul > 0.9 AND ur > 0.9 THEN 'inner' ELSE 'left' END AS merge_type,
  round((0.3 * name_similarity + 0.5 * ov + 0.2 * greatest(ul, ur)) + sign((0.3 * name_similarity + 0.5 * ov + 0.2 * greatest(ul, ur))) * 1e-6, 3) AS confidence,
  round((ov) + sign((ov)) * 1e-9, 6) AS value_overlap, round((ul) + sign((ul)) * 1e-9, 6) AS left_uniqueness, round((ur) + sign((ur)) * 1e-9, 6) AS right_uniqueness,
  printf('Name similarity: %.0f%%; Value overlap: %.0f%%; Uniqueness L: %.0f%%, R: %.0f%%',
         name_similarity * 100, ov * 100, ul * 100, ur * 100) AS rationale
FROM m WHERE ov >= 0.1"""


@query("detect_keys_orders_customer", _detect_sql())
def detect_keys_orders_customer(spark, d):
    """Ranked join-key candidates over orders, customer, nation,
    region (name tokens normalised, token-set intersection over union)."""
    return mg.detect_keys({t: load(spark, d, t) for t in _DETECT})


@query("merge_plan_choice", f"""
SELECT * FROM ({_detect_sql()}) ORDER BY confidence DESC, plan_id LIMIT 4""")
def merge_plan_choice(spark, d):
    """Best plan and three alternatives, by confidence descending."""
    return mg.choose_plans(detect_keys_orders_customer(spark, d))


@query("merge_best_plan", """
SELECT o.*, c.*, n.*, r.* FROM orders o
LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey
LEFT JOIN nation n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey
LEFT JOIN region r ON n.n_regionkey IS NOT DISTINCT FROM r.r_regionkey""")
def merge_best_plan(spark, d):
    """Merge the four tables along the detected plans, best first."""
    return mg.merge_by_best_plan({t: load(spark, d, t) for t in _DETECT})


@query("value_overlap", """
WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL),
b AS (SELECT DISTINCT c_custkey AS v FROM customer WHERE c_custkey IS NOT NULL),
c AS (SELECT v FROM a INTERSECT SELECT v FROM b)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right,
       (SELECT count(*) FROM c) AS n_common,
       round((CASE WHEN least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) > 0
             THEN (SELECT count(*) FROM c) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b))
             ELSE 0 END) + sign((CASE WHEN least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) > 0
             THEN (SELECT count(*) FROM c) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b))
             ELSE 0 END)) * 1e-9, 6) AS overlap""")
def value_overlap(spark, d):
    """Overlap of the distinct order-customer keys."""
    return mg.value_overlap(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer"), "c_custkey")


_SIZE_SQL = """
WITH a AS (SELECT {lk} AS k, count(*) AS nl FROM {lt} GROUP BY {lk}),
b AS (SELECT {rk} AS k, count(*) AS nr FROM {rt} GROUP BY {rk}),
j AS (SELECT nl, nr FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k),
g AS (SELECT CAST(coalesce(sum(nl), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(nr), 0) AS BIGINT) AS right_rows,
  CAST(coalesce(sum(nl), 0) - count(nl) AS BIGINT) AS left_duplicates,
  CAST(coalesce(sum(nr), 0) - count(nr) AS BIGINT) AS right_duplicates,
  CAST(coalesce(sum(CASE WHEN nl IS NOT NULL AND nr IS NOT NULL THEN nl * nr ELSE 0 END), 0) AS BIGINT) AS inner_rows,
  CAST(coalesce(sum(CASE WHEN nl IS NOT NULL AND nr IS NULL THEN nl END), 0) AS BIGINT) AS lo,
  CAST(coalesce(sum(CASE WHEN nr IS NOT NULL AND nl IS NULL THEN nr END), 0) AS BIGINT) AS ro FROM j)
SELECT left_rows, right_rows, left_duplicates, right_duplicates,
  left_duplicates > 0 AND right_duplicates > 0 AS many_to_many, inner_rows,
  inner_rows + lo AS left_join_rows, inner_rows + ro AS right_join_rows, inner_rows + lo + ro AS outer_rows,
  left_rows * right_rows AS worst_case_rows, {pred} AS predicted_rows,
  {pred} > 2 * greatest(left_rows, right_rows) AS explosion
FROM g"""


@query("merge_size", _SIZE_SQL.format(lk="c_nationkey", lt="customer", rk="s_nationkey",
                                      rt="supplier", pred="inner_rows"))
def merge_size(spark, d):
    """Exact many-to-many join size of customer ⋈ supplier on nation,
    from grouped counts (the join itself never runs)."""
    return mg.merge_size(load(spark, d, "customer"), load(spark, d, "supplier"),
                         "c_nationkey", "s_nationkey", "inner")


@query("merge_size_orders", _SIZE_SQL.format(lk="o_custkey", lt="orders", rk="c_custkey",
                                             rt="customer", pred="inner_rows + lo"))
def merge_size_orders(spark, d):
    """Exact left-join size of orders ⋈ customer (one-to-many)."""
    return mg.merge_size(load(spark, d, "orders"), load(spark, d, "customer"),
                         "o_custkey", "c_custkey", "left")


@query("merge_left", """
SELECT o.*, c.* FROM orders o LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""",
       headline=True)
def merge_left(spark, d):
    """One-to-many left merge of orders with customers."""
    return mg.merge(load(spark, d, "orders"), load(spark, d, "customer"), "o_custkey", "c_custkey", "left")


@query("merge_outer_nullsafe", """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_custkey END AS custkey,
                  o_totalprice AS amount FROM orders),
r AS (SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey END AS custkey, c_name,
             c_acctbal AS amount FROM customer)
SELECT l.o_orderkey, coalesce(l.custkey, r.custkey) AS custkey, l.amount AS amount_x,
       r.c_name, r.amount AS amount_y
FROM l FULL OUTER JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey""")
def merge_outer_nullsafe(spark, d):
    """Outer merge where null keys match null keys, one shared key name
    (collapsed) and one clashing name (suffixed)."""
    l = load(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 1000 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("custkey"),
        F.col("o_totalprice").alias("amount"))
    r = load(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 500 == 0, F.lit(None)).otherwise(F.col("c_custkey")).alias("custkey"),
        "c_name", F.col("c_acctbal").alias("amount"))
    return mg.merge(l, r, "custkey", "custkey", "outer")


@query("merge_chain", """
SELECT o.*, c.*, n.*, r.* FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""", headline=True)
def merge_chain(spark, d):
    """Every step of a multi-table merge plan, folded."""
    return mg.merge_chain(load(spark, d, "orders"), [
        (load(spark, d, "customer"), "o_custkey", "c_custkey", "inner"),
        (load(spark, d, "nation"), "c_nationkey", "n_nationkey", "inner"),
        (load(spark, d, "region"), "n_regionkey", "r_regionkey", "inner")], null_keys_match=False)


@query("merge_summary_orders", """
SELECT true AS success, CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns
FROM orders o LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def merge_summary_orders(spark, d):
    """Join summary (rows predicted exactly, never materialised)."""
    s = mg.merge_summary(load(spark, d, "orders"), load(spark, d, "customer"),
                         "o_custkey", "c_custkey", "left")
    return s.select("success", "n_rows", "n_columns")


@query("category_mean_lookup", """
SELECT o.*, round((avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) + sign((avg(o_totalprice) OVER (PARTITION BY o_orderpriority))) * 1e-9, 6) AS o_orderpriority_mean
FROM orders o""")
def category_mean_lookup(spark, d):
    """Per-category mean attached to every row by a join on the
    grouped means (one row per category)."""
    return round_doubles(mg.lookup_statistic(load(spark, d, "orders"), "o_orderpriority",
                                             "o_totalprice", "mean"))


@query("flagship_merge_profile", """
WITH j AS (SELECT o.*, c.* FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)
""" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM j"
    for i, (c, _, _) in enumerate(ORDERS_COLS + CUSTOMER_COLS)))
def flagship_merge_profile(spark, d):
    """S1 → J3 → J1 → A1: detect the best key of orders/customer, merge on
    it with the detected join type, profile the result."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    best = mg.choose_plans(mg.detect_keys({"orders": o, "customer": c}), 0).first()
    joined = mg.merge(o, c, best["left_key"], best["right_key"], best["merge_type"])
    return prof.profile(joined).select("position", "column_name", "null_count", "unique_count")


@query("duplicate_flags", """
SELECT l_orderkey, l_linenumber, l_partkey,
       row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) > 1 AS is_duplicate
FROM lineitem""")
def duplicate_flags(spark, d):
    """Every line after the first of its part is a duplicate of the key."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return mg.duplicate_flags(li, ["l_partkey"], ["l_orderkey", "l_linenumber"])
