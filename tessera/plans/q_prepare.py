"""Queries for imputation, encoding, scaling and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import prepare as pp
from tessera.plans.q_ingest import EVENTS_NULLS_SQL, _events_with_nulls
from tessera.plans.registry import load, query, round_doubles

_EV = f"WITH e AS ({EVENTS_NULLS_SQL})"
_EV_COLS = "event_id, ts, user_id"


@query("impute_drop", f"""{_EV} SELECT * FROM e WHERE value IS NOT NULL""")
def impute_drop(spark, d):
    """Drop rows whose value is missing."""
    return pp.handle_missing(_events_with_nulls(spark, d), {"value": "drop"})[0]


@query("impute_mean", f"""{_EV}
SELECT {_EV_COLS}, event_type, round((coalesce(value, (SELECT avg(value) FROM e))) + sign((coalesce(value, (SELECT avg(value) FROM e)))) * 1e-9, 6) AS value, props FROM e""")
def impute_mean(spark, d):
    """Mean fill."""
    return round_doubles(pp.handle_missing(_events_with_nulls(spark, d), {"value": "mean"})[0])


@query("impute_median", f"""{_EV}
SELECT {_EV_COLS}, event_type, round((coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e))) + sign((coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)))) * 1e-9, 6) AS value,
       props FROM e""")
def impute_median(spark, d):
    """Exact median fill."""
    return round_doubles(pp.handle_missing(_events_with_nulls(spark, d), {"value": "median"})[0])


@query("impute_mode", f"""{_EV},
m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT {_EV_COLS}, coalesce(event_type, (SELECT v FROM m)) AS event_type, value, props FROM e""")
def impute_mode(spark, d):
    """Most frequent value, ties to the smallest."""
    return pp.handle_missing(_events_with_nulls(spark, d), {"event_type": "mode"})[0]


@query("impute_constant", f"""{_EV}
SELECT {_EV_COLS}, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1.0) AS value, props FROM e""")
def impute_constant(spark, d):
    """E5/F8: typed constants (text 'unknown', number -1)."""
    return pp.handle_missing(_events_with_nulls(spark, d),
                             {"event_type": "unknown", "value": "constant:-1"})[0]


@query("impute_ffill", f"""{_EV}
SELECT {_EV_COLS}, event_type,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, props FROM e""")
def impute_ffill(spark, d):
    """Forward fill per user along (ts, event_id)."""
    return pp.handle_missing(_events_with_nulls(spark, d), {"value": "forward_fill"},
                             order_by=["ts", "event_id"], keys=["user_id"])[0]


@query("impute_bfill", f"""{_EV}
SELECT {_EV_COLS}, event_type,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value, props FROM e""")
def impute_bfill(spark, d):
    """Backward fill per user."""
    return pp.handle_missing(_events_with_nulls(spark, d), {"value": "backward_fill"},
                             order_by=["ts", "event_id"], keys=["user_id"])[0]


@query("impute_ffill_global", f"""{_EV}
SELECT {_EV_COLS}, event_type,
  last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
  last_value(props IGNORE NULLS) OVER (ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props FROM e""")
def impute_ffill_global(spark, d):
    """W1 without a key: range-partitioned fill with carried values, no
    single-partition window."""
    ev = _events_with_nulls(spark, d)
    return pp.fill_along(ev, ["value", "props"], ["ts", "event_id"])


@query("impute_plan", f"""{_EV},
m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
p AS (SELECT props AS v FROM e WHERE props IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT {_EV_COLS}, coalesce(event_type, (SELECT v FROM m)) AS event_type,
  round((coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e))) + sign((coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)))) * 1e-9, 6) AS value,
  coalesce(props, (SELECT v FROM p)) AS props FROM e""")
def impute_plan(spark, d):
    """Default plan (numeric → median, other → mode) applied in order."""
    ev = _events_with_nulls(spark, d)
    plan = pp.default_strategies(ev)
    return round_doubles(pp.handle_missing(ev, plan)[0])


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("encode_onehot", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in _SEGS)
    + " FROM customer")
def encode_onehot(spark, d):
    """One-hot columns named column_value (all categories kept)."""
    cu = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return pp.fit_encoder(cu, "c_mktsegment", "one_hot").transform(cu)


@query("encode_label", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM customer""")
def encode_label(spark, d):
    """code = rank of the text value."""
    cu = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return pp.fit_encoder(cu, "c_mktsegment", "label").transform(cu)


@query("encode_ordinal", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'nan' ELSE c_mktsegment END AS s FROM customer)
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY s) - 1 AS BIGINT) AS c_mktsegment FROM c""")
def encode_ordinal(spark, d):
    """Ordinal codes with null as the category 'nan'."""
    cu = load(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"))
    return pp.fit_encoder(cu, "c_mktsegment", "ordinal").transform(cu)


@query("encode_target", """
SELECT c_custkey, round((avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) + sign((avg(c_acctbal) OVER (PARTITION BY c_mktsegment))) * 1e-9, 6) AS c_mktsegment, c_acctbal FROM customer""")
def encode_target(spark, d):
    """Category replaced by the target mean of its group."""
    cu = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return round_doubles(pp.fit_encoder(cu, "c_mktsegment", "target", target="c_acctbal").transform(cu))


@query("encode_target_join", """
SELECT o_orderkey, round((avg(o_totalprice) OVER (PARTITION BY o_custkey)) + sign((avg(o_totalprice) OVER (PARTITION BY o_custkey))) * 1e-9, 6) AS o_custkey, o_totalprice FROM orders""")
def encode_target_join(spark, d):
    """E12 for a high-cardinality key: grouped means joined back."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return round_doubles(pp.target_encode_join(o, "o_custkey", "o_totalprice"))


@query("scale_standard", """
SELECT c_custkey, round(((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()) + sign(((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ())) * 1e-9, 6) AS c_acctbal,
       round(((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER ()) + sign(((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER ())) * 1e-9, 6) AS c_nationkey
FROM customer""")
def scale_standard(spark, d):
    """(x − mean) / population deviation."""
    cu = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return round_doubles(pp.fit_scaler(cu, ["c_acctbal", "c_nationkey"], "standard").transform(cu))


@query("scale_minmax", """
SELECT p_partkey, round(((p_retailprice - min(p_retailprice) OVER ()) /
                        (max(p_retailprice) OVER () - min(p_retailprice) OVER ())) + sign(((p_retailprice - min(p_retailprice) OVER ()) /
                        (max(p_retailprice) OVER () - min(p_retailprice) OVER ()))) * 1e-9, 6) AS p_retailprice,
       round(((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())) + sign(((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()))) * 1e-9, 6) AS p_size
FROM part""")
def scale_minmax(spark, d):
    """Scaled to [0, 1]."""
    p = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return round_doubles(pp.fit_scaler(p, ["p_retailprice", "p_size"], "minmax").transform(p))


@query("scale_robust", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(((l_extendedprice - m) / (q3 - q1)) + sign(((l_extendedprice - m) / (q3 - q1))) * 1e-9, 6) AS l_extendedprice FROM lineitem, q""")
def scale_robust(spark, d):
    """(x − median) / IQR with exact quartiles."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return round_doubles(pp.fit_scaler(li, ["l_extendedprice"], "robust").transform(li))


@query("poly", """
SELECT p_partkey, p_size, p_retailprice,
  round((CAST(coalesce(p_size, 0) AS DOUBLE) * coalesce(p_size, 0)) + sign((CAST(coalesce(p_size, 0) AS DOUBLE) * coalesce(p_size, 0))) * 1e-9, 6) AS "p_size^2",
  round((CAST(coalesce(p_size, 0) AS DOUBLE) * coalesce(p_retailprice, 0)) + sign((CAST(coalesce(p_size, 0) AS DOUBLE) * coalesce(p_retailprice, 0))) * 1e-9, 6) AS "p_size p_retailprice",
  round((coalesce(p_retailprice, 0) * coalesce(p_retailprice, 0)) + sign((coalesce(p_retailprice, 0) * coalesce(p_retailprice, 0))) * 1e-9, 6) AS "p_retailprice^2"
FROM part""")
def poly(spark, d):
    """Degree-2 polynomial terms with their conventional names."""
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return round_doubles(pp.polynomial_features(p, ["p_size", "p_retailprice"], 2))


@query("interact", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
       round((coalesce(l_quantity, 0) * coalesce(l_discount, 0)) + sign((coalesce(l_quantity, 0) * coalesce(l_discount, 0))) * 1e-9, 6) AS l_quantity_x_l_discount FROM lineitem""")
def interact(spark, d):
    """a_x_b products."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return round_doubles(pp.interaction_features(li, [("l_quantity", "l_discount")]))


@query("feature_chain_part", """
SELECT p_partkey,
  round(((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()) + sign(((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ())) * 1e-9, 6) AS p_size,
  round(((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()) + sign(((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ())) * 1e-9, 6) AS p_retailprice,
  round((CAST(p_size AS DOUBLE) * p_size) + sign((CAST(p_size AS DOUBLE) * p_size)) * 1e-9, 6) AS "p_size^2",
  round((CAST(p_size AS DOUBLE) * p_retailprice) + sign((CAST(p_size AS DOUBLE) * p_retailprice)) * 1e-9, 6) AS "p_size p_retailprice",
  round((p_retailprice * p_retailprice) + sign((p_retailprice * p_retailprice)) * 1e-9, 6) AS "p_retailprice^2",
  round((CAST(p_size AS DOUBLE) * p_retailprice) + sign((CAST(p_size AS DOUBLE) * p_retailprice)) * 1e-9, 6) AS p_size_x_p_retailprice
FROM part""")
def feature_chain_part(spark, d):
    """Polynomial → interactions → scaling of the original numerics."""
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return round_doubles(pp.feature_chain(p, target="p_partkey", pairs=[("p_size", "p_retailprice")]))


@query("declared_steps", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
                  c_mktsegment FROM customer),
f AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)) AS c_acctbal,
             CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM c)
SELECT c_custkey, round(((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()) + sign(((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ())) * 1e-9, 6) AS c_acctbal,
       c_mktsegment FROM f""")
def declared_steps(spark, d):
    """A declared impute → encode → scale chain, fitted then applied."""
    cu = load(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment")
    chain = pp.StepChain([pp.Step("impute", ["c_acctbal"], "median"),
                          pp.Step("encode", ["c_mktsegment"], "label"),
                          pp.Step("scale", ["c_acctbal"], "standard")]).fit(cu)
    return round_doubles(chain.transform(cu))


@query("model_matrix", """
WITH j AS (SELECT o.o_totalprice, o.o_orderpriority, o.o_orderstatus, c.c_acctbal, c.c_mktsegment
           FROM orders o LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey)
SELECT coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM j)) AS o_totalprice,
       coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM j)) AS c_acctbal,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_2-HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_3-MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_4-NOT SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_5-LOW",
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS c_mktsegment_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END AS c_mktsegment_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END AS c_mktsegment_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS c_mktsegment_MACHINERY,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus
FROM j""")
def model_matrix(spark, d):
    """The shared model matrix of orders ⋈ customer with the order
    status as text target (one-hot drop-first, median fill, label target)."""
    from tessera.operators.merge import merge
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = merge(o, c, "o_custkey", "c_custkey", "left").drop("c_custkey")
    mm = pp.fit_model_matrix(j, "o_orderstatus", ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment"])
    return mm.transform(j)


@query("encode_auto", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P,
  CAST(dense_rank() OVER (ORDER BY o_clerkish) - 1 AS BIGINT) AS o_clerkish
FROM (SELECT o_orderkey, o_orderstatus, 'clerk-' || CAST(o_custkey % 40 AS VARCHAR) AS o_clerkish FROM orders)""")
def encode_auto(spark, d):
    """Automatic choice — one-hot under 10 distinct values, label above."""
    o = load(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.concat(F.lit("clerk-"), (F.col("o_custkey") % 40).cast("string")).alias("o_clerkish"))
    plan = pp.auto_encoding(o, ["o_orderstatus", "o_clerkish"])
    for col, method in plan.items():
        o = pp.fit_encoder(o, col, method).transform(o)
    return o
