"""Queries for exploratory data (A5-A23) and type management."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dtypes as dty
from tessera.operators import explore as ex
from tessera.operators import payload as pl
from tessera.operators import profile as prof
from tessera.plans.q_ingest import EVENTS_NULLS_SQL, _events_with_nulls
from tessera.plans.registry import load, query, round_doubles


@query("histogram_price", """
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, count(l_extendedprice) AS n FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - mn) * 50 / (mx - mn)), 49) AS INTEGER) AS bin
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
SELECT g.bin, round((mn + g.bin * ((mx - mn) / 50)) + sign((mn + g.bin * ((mx - mn) / 50))) * 1e-9, 6) AS lower,
       round((mn + (g.bin + 1) * ((mx - mn) / 50)) + sign((mn + (g.bin + 1) * ((mx - mn) / 50))) * 1e-9, 6) AS upper,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round((coalesce(cnt, 0) / (n * ((mx - mn) / 50))) + sign((coalesce(cnt, 0) / (n * ((mx - mn) / 50)))) * 1e-9, 6) AS density
FROM g LEFT JOIN c ON g.bin = c.bin, s""", headline=True)
def histogram_price(spark, d):
    """A5: 50-bin histogram of the extended price."""
    return round_doubles(ex.histogram(load(spark, d, "lineitem"), "l_extendedprice", 50))


@query("kde_quantity", """
WITH s AS (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx, count(l_quantity) AS n,
                  stddev_samp(l_quantity) AS sd FROM lineitem),
p AS (SELECT *, sd * pow(n, -0.2) AS bw, (mx - mn) / 299 AS step FROM s),
v AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
g AS (SELECT range AS g FROM range(300)),
k AS (SELECT g, mn + g * step AS x, sum(c * exp(-0.5 * ((mn + g * step - v) / bw) ** 2)) / (n * bw * sqrt(2 * pi())) AS density
      FROM g, v, p GROUP BY g, mn, step, n, bw)
SELECT CAST(g AS INTEGER) AS grid_index, round(x + sign(x) * 1e-9, 6) AS x, round(density + sign(density) * 1e-9, 6) AS density FROM k""")
def kde_quantity(spark, d):
    """Gaussian density of quantity on 300 grid points."""
    return round_doubles(ex.kde(load(spark, d, "lineitem"), "l_quantity"))


@query("summary_price", """
SELECT count(l_extendedprice) AS n, round((avg(l_extendedprice)) + sign((avg(l_extendedprice))) * 1e-9, 6) AS mean,
       round((stddev_samp(l_extendedprice)) + sign((stddev_samp(l_extendedprice))) * 1e-9, 6) AS std FROM lineitem""")
def summary_price(spark, d):
    """N, mean, sample deviation (rounded to 6 places)."""
    return round_doubles(ex.summary(load(spark, d, "lineitem"), "l_extendedprice"))


@query("top_types", """
WITH c AS (SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type),
n AS (SELECT count(*) AS n_categories FROM c)
SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS rank, n_categories
FROM (SELECT * FROM c ORDER BY count DESC, value LIMIT 30) t, n""")
def top_types(spark, d):
    """30 most frequent part types and the number of types."""
    return ex.top_categories(load(spark, d, "part"), "p_type", 30)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    [f"SELECT '{a}' AS row, '{b}' AS col, round((corr({a}, {b})) + sign((corr({a}, {b}))) * 1e-9, 6) AS r FROM lineitem"
     for a in _CORR_COLS for b in _CORR_COLS if a != b]
    + [f"SELECT '{a}' AS row, '{a}' AS col, 1.0::DOUBLE AS r" for a in _CORR_COLS]))
def corr_matrix(spark, d):
    """Pearson matrix of the line-item measures (one aggregation)."""
    return round_doubles(ex.correlation_matrix(load(spark, d, "lineitem"), _CORR_COLS))


@query("feature_rank", """
WITH r AS (
  SELECT 'l_quantity' AS feature, least(round((abs(corr(l_quantity, l_extendedprice))) + sign((abs(corr(l_quantity, l_extendedprice)))) * 1e-6, 3), 1.0) AS score FROM lineitem
  UNION ALL SELECT 'l_discount', least(round((abs(corr(l_discount, l_extendedprice))) + sign((abs(corr(l_discount, l_extendedprice)))) * 1e-6, 3), 1.0) FROM lineitem
  UNION ALL SELECT 'l_tax', least(round((abs(corr(l_tax, l_extendedprice))) + sign((abs(corr(l_tax, l_extendedprice)))) * 1e-6, 3), 1.0) FROM lineitem
  UNION ALL SELECT 'l_linenumber', least(round((abs(corr(l_linenumber, l_extendedprice))) + sign((abs(corr(l_linenumber, l_extendedprice)))) * 1e-6, 3), 1.0) FROM lineitem
  UNION ALL SELECT 'l_linestatus', 0.3)
SELECT feature, coalesce(score, 0.0) AS score, coalesce(score, 0.0) > 0.01 AS included FROM r""")
def feature_rank(spark, d):
    """Features ranked by |corr| with the price; text features get 0.3."""
    li = load(spark, d, "lineitem")
    return ex.feature_ranking(li, "l_extendedprice",
                              ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"])


@query("box_by_flag", """
WITH q AS (SELECT l_returnflag AS "group", count(*) AS n,
                  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1),
j AS (SELECT q.*, l.l_extendedprice AS x FROM q JOIN lineitem l ON l.l_returnflag = q."group")
SELECT "group", n, round((q1) + sign((q1)) * 1e-9, 6) AS q1, round((median) + sign((median)) * 1e-9, 6) AS median, round((q3) + sign((q3)) * 1e-9, 6) AS q3,
  round((min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END)) + sign((min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END))) * 1e-9, 6) AS whisker_low,
  round((max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END)) + sign((max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END))) * 1e-9, 6) AS whisker_high,
  CAST(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM j GROUP BY "group", n, q1, median, q3""")
def box_by_flag(spark, d):
    """Box statistics of price per return flag."""
    return round_doubles(ex.box_stats(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("crosstab_flag_status", """
WITH c AS (SELECT l_returnflag AS row_value, l_linestatus AS col_value, count(*) AS count
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2)
SELECT row_value, col_value, count, round((count / sum(count) OVER (PARTITION BY row_value)) + sign((count / sum(count) OVER (PARTITION BY row_value))) * 1e-9, 6) AS share FROM c""")
def crosstab_flag_status(spark, d):
    """Row-normalised cross-tab of return flag by line status."""
    return round_doubles(ex.crosstab(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("scatter_density", """
WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                  max(l_extendedprice) AS y1 FROM lineitem)
SELECT l_returnflag AS hue,
  CAST(least(floor((l_quantity - x0) * 20 / (x1 - x0)), 19) AS INTEGER) AS x_bin,
  CAST(least(floor((l_extendedprice - y0) * 20 / (y1 - y0)), 19) AS INTEGER) AS y_bin,
  count(*) AS count
FROM lineitem, r WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL
GROUP BY 1, 2, 3""")
def scatter_density(spark, d):
    """A10: 20×20 binned scatter of quantity × price per return flag."""
    return ex.scatter_density(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("quality_flags", """
WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS a3,
                  quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.75) AS b3,
                  quantile_cont(l_discount, 0.25) AS c1, quantile_cont(l_discount, 0.75) AS c3 FROM lineitem),
o AS (SELECT
   sum(CASE WHEN l_quantity < a1 - 1.5 * (a3 - a1) OR l_quantity > a3 + 1.5 * (a3 - a1) THEN 1 ELSE 0 END) AS oa,
   sum(CASE WHEN l_extendedprice < b1 - 1.5 * (b3 - b1) OR l_extendedprice > b3 + 1.5 * (b3 - b1) THEN 1 ELSE 0 END) AS ob,
   sum(CASE WHEN l_discount < c1 - 1.5 * (c3 - c1) OR l_discount > c3 + 1.5 * (c3 - c1) THEN 1 ELSE 0 END) AS oc,
   count(*) AS n, count(DISTINCT l_quantity) AS da, count(DISTINCT l_extendedprice) AS db,
   count(DISTINCT l_discount) AS dc, count(DISTINCT l_returnflag) AS dd, count(DISTINCT l_orderkey) AS de,
   count(*) - count(l_quantity) AS na, count(*) - count(l_extendedprice) AS nb, count(*) - count(l_discount) AS nc,
   count(*) - count(l_returnflag) AS nd, count(*) - count(l_orderkey) AS ne
   FROM lineitem, q)
SELECT 'l_quantity' AS column_name, round((oa * 100.0 / n) + sign((oa * 100.0 / n)) * 1e-7, 4)::DOUBLE AS outlier_pct, da <= 1 AS is_constant,
       na * 100.0 / n > 30 AS high_nulls, da = n AND na = 0 AS is_grain FROM o
UNION ALL SELECT 'l_extendedprice', round((ob * 100.0 / n) + sign((ob * 100.0 / n)) * 1e-7, 4)::DOUBLE, db <= 1, nb * 100.0 / n > 30, db = n AND nb = 0 FROM o
UNION ALL SELECT 'l_discount', round((oc * 100.0 / n) + sign((oc * 100.0 / n)) * 1e-7, 4)::DOUBLE, dc <= 1, nc * 100.0 / n > 30, dc = n AND nc = 0 FROM o
UNION ALL SELECT 'l_returnflag', NULL::DOUBLE, dd <= 1, nd * 100.0 / n > 30, dd = n AND nd = 0 FROM o
UNION ALL SELECT 'l_orderkey', NULL::DOUBLE, de <= 1, ne * 100.0 / n > 30, de = n AND ne = 0 FROM o""")
def quality_flags(spark, d):
    """Outlier share, constant, high-null and grain flags per column."""
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount",
                                           "l_returnflag", F.col("l_orderkey").cast("string").alias("l_orderkey"))
    return round_doubles(prof.quality_flags(li), 4)


@query("target_stats", """
WITH c AS (SELECT quality AS cls, count(*) AS n FROM labels GROUP BY 1)
SELECT 'quality' AS target, 'int' AS dtype, count(cls) AS n_distinct,
       round((coalesce(sum(CASE WHEN cls IS NULL THEN n END), 0) * 100.0 / sum(n)) + sign((coalesce(sum(CASE WHEN cls IS NULL THEN n END), 0) * 100.0 / sum(n))) * 1e-5, 2)::DOUBLE AS null_pct,
       CASE WHEN count(cls) <= 10 THEN map_from_entries(list((CAST(cls AS VARCHAR), n) ORDER BY cls)
            FILTER (WHERE cls IS NOT NULL)) END AS class_counts
FROM c""")
def target_stats(spark, d):
    """Statistics of the quality label."""
    return prof.target_stats(load(spark, d, "labels"), "quality")


@query("base_rate", """
WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)
SELECT CASE WHEN count(*) = 2 THEN round((min(n) / sum(n)) + sign((min(n) / sum(n))) * 1e-9, 6) ELSE 0.25 END AS base_rate FROM c""")
def base_rate(spark, d):
    """Share of the smaller class."""
    return ex.base_rate(load(spark, d, "labels"), "quality")


@query("class_balance", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_classes, min(n) AS minority, max(n) AS majority, round((min(n) / max(n)) + sign((min(n) / max(n))) * 1e-9, 6) AS class_balance FROM c""")
def class_balance(spark, d):
    """Minority / majority ratio of the toxic label."""
    return prof.class_balance(load(spark, d, "labels"), "toxic")


@query("data_characteristics", """
WITH p AS (
  SELECT 'l_orderkey' AS c, 'bigint' AS t, count(DISTINCT l_orderkey) AS u FROM lineitem
  UNION ALL SELECT 'l_quantity', 'double', count(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'double', count(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_linestatus', 'string', count(DISTINCT l_linestatus) FROM lineitem
  UNION ALL SELECT 'l_shipdate', 'timestamp_ntz', count(DISTINCT l_shipdate) FROM lineitem),
cb AS (SELECT round((min(n) / max(n)) + sign((min(n) / max(n))) * 1e-9, 6) AS class_balance
       FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1))
SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS n_features,
  CAST(sum(CASE WHEN t IN ('bigint', 'double') THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric,
  CAST(sum(CASE WHEN t = 'string' THEN 1 ELSE 0 END) AS BIGINT) AS n_categorical,
  coalesce(list_sort(list(c) FILTER (WHERE t = 'string' AND u > 20)), []) AS high_cardinality,
  (SELECT class_balance FROM cb) AS class_balance
FROM p""")
def data_characteristics(spark, d):
    """Table characteristics with the return flag as target."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice",
                                           "l_linestatus", "l_shipdate", "l_returnflag")
    return prof.data_characteristics(li, "l_returnflag")


@query("group_means", """
SELECT o_orderpriority, round((avg(o_totalprice)) + sign((avg(o_totalprice))) * 1e-9, 6) AS mean_o_totalprice, count(*) AS n
FROM orders GROUP BY 1""")
def group_means(spark, d):
    """Mean total price per priority."""
    return round_doubles(ex.group_means(load(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


_MEASURES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("target_analysis_lineitem", " UNION ALL ".join(f"""
(WITH q AS (SELECT l_returnflag AS g, count({c}) AS n, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median,
                   quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)
 SELECT '{c}' AS feature, g AS "group", n, round(q1 + 1e-9, 6) AS q1, round(median + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3,
        round(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) + 1e-9, 6) AS whisker_low,
        round(max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) + 1e-9, 6) AS whisker_high,
        count(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
 FROM q JOIN (SELECT l_returnflag AS f, {c}::DOUBLE AS x FROM lineitem WHERE {c} IS NOT NULL) ON f IS NOT DISTINCT FROM g
 GROUP BY g, n, q1, median, q3)""" for c in _MEASURES))
def target_analysis_lineitem(spark, d):
    """The analysis of every numeric column against the return flag (box plots), as one typed table."""
    li = load(spark, d, "lineitem")
    parts = ex.target_analysis(li, "l_returnflag", ex.auto_features(li, "l_returnflag"))
    return round_doubles(ex.analysis_table(parts))


# ---- type management -------------------------------------------------------

@query("suggest_types_events", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_txt, CAST(value AS VARCHAR) AS value_txt,
                  strftime(ts, '%m/%d/%Y') AS day_txt, event_type,
                  CAST(floor(value) AS DOUBLE) AS value_floor, value FROM events)
SELECT 'user_txt' AS "column", 'string' AS current_dtype, 'int' AS suggested_dtype,
       'values are mostly integers stored as text' AS reason, 1.0 AS confidence
UNION ALL SELECT 'value_txt', 'string', 'float', 'values are mostly decimals stored as text', 1.0
UNION ALL SELECT 'day_txt', 'string', 'datetime', 'values look like dates or times', 1.0
UNION ALL SELECT 'event_type', 'string', 'category',
       'low cardinality (' || (SELECT count(DISTINCT event_type) FROM e) || ' distinct values)',
       round((1 - (SELECT count(DISTINCT event_type) FROM e) / (SELECT count(*) FROM e)) + sign((1 - (SELECT count(DISTINCT event_type) FROM e) / (SELECT count(*) FROM e))) * 1e-6, 3)
UNION ALL SELECT 'value_floor', 'double', 'int', 'all non-null values are whole numbers', 0.95""")
def suggest_types_events(spark, d):
    """D3: value-based type suggestions on text renderings of event columns."""
    ev = load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("user_txt"), F.col("value").cast("string").alias("value_txt"),
        F.date_format("ts", "MM/dd/yyyy").alias("day_txt"), "event_type",
        F.floor("value").cast("double").alias("value_floor"), "value")
    return dty.suggest_types(ev)


@query("cast_validate", """
WITH e AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'n/a-' || CAST(event_id AS VARCHAR)
                       ELSE CAST(value AS VARCHAR) END AS value_txt, event_id FROM events)
SELECT event_id, TRY_CAST(trim(value_txt) AS DOUBLE) AS value_num,
       CASE WHEN TRY_CAST(trim(value_txt) AS DOUBLE) = floor(TRY_CAST(trim(value_txt) AS DOUBLE))
            THEN CAST(TRY_CAST(trim(value_txt) AS DOUBLE) AS BIGINT) END AS value_int,
       length(value_txt) > 0 AS value_bool, value_txt AS value_str
FROM e""")
def cast_validate(spark, d):
    """Coercing casts of a dirty text column (every 9th
    value is not a number) to float, int, bool and text in one projection."""
    ev = load(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("n/a-"), F.col("event_id").cast("string")))
        .otherwise(F.col("value").cast("string")).alias("value_txt"))
    out = ev.select("event_id", "value_txt", F.col("value_txt").alias("value_num"),
                    F.col("value_txt").alias("value_int"), F.col("value_txt").alias("value_bool"),
                    F.col("value_txt").alias("value_str"))
    out = dty.apply_corrections(out, [("value_num", "float"), ("value_int", "int"),
                                      ("value_bool", "bool"), ("value_str", "str")])
    return out.drop("value_txt")


@query("cast_report", """
SELECT 'value_txt' AS "column", 'string' AS original_dtype, 'double' AS new_dtype, count(*) AS rows,
       CAST(sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_coerced_null FROM events""")
def cast_report(spark, d):
    """Cast report — how many values the coercion turned into null."""
    ev = load(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("n/a-"), F.col("event_id").cast("string")))
        .otherwise(F.col("value").cast("string")).alias("value_txt"))
    return dty.cast_column(ev, "value_txt", "float")[1]


@query("parse_dates", """
WITH e AS (SELECT event_id, ts,
  CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%m/%d/%Y')
       ELSE strftime(ts, '%d.%m.%Y') END AS day_txt FROM events)
SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS parsed FROM e""")
def parse_dates(spark, d):
    """ISO, US and European day layouts parsed by one coalesce."""
    from tessera.functions.scalar import to_timestamp_any
    ev = load(spark, d, "events")
    txt = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
           .when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy"))
           .otherwise(F.date_format("ts", "dd.MM.yyyy")))
    return ev.select("event_id", to_timestamp_any(txt).cast("timestamp_ntz").alias("parsed"))


@query("json_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, d):
    """a field of the JSON payload as a typed column."""
    ev = load(spark, d, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_PAYLOAD = """CASE event_id % 6 WHEN 0 THEN props
  WHEN 1 THEN '{"k": "' || event_type || '", "who": {"id": ' || CAST(user_id AS VARCHAR) || ', "tags": ["a", 1, null, [2]]}}'
  WHEN 2 THEN '{"k": null, "who": {"id": null}}' WHEN 3 THEN '{"k": 1.5, "ok": true, "who": []}' WHEN 4 THEN '{broken' END"""


def _payloads(spark, d):
    return load(spark, d, "events").select("event_id", F.expr(_PAYLOAD.replace("VARCHAR", "STRING")).alias("payload"))


@query("payload_keys", f"""
WITH p AS (SELECT {_PAYLOAD} AS j FROM events),
v AS (SELECT j::JSON AS j FROM p WHERE json_valid(j)),
t AS (
  SELECT '$.k' AS path, json_type(j, '$.k') AS t FROM v UNION ALL SELECT '$.ok', json_type(j, '$.ok') FROM v
  UNION ALL SELECT '$.who', json_type(j, '$.who') FROM v UNION ALL SELECT '$.who.id', json_type(j, '$.who.id') FROM v
  UNION ALL SELECT '$.who.tags', json_type(j, '$.who.tags') FROM v
  UNION ALL SELECT '$.who.tags[]', json_type(unnest(json_extract(j, '$.who.tags[*]'))) FROM v
  UNION ALL SELECT '$.who.tags[][]', json_type(unnest(json_extract(j, '$.who.tags[3][*]'))) FROM v)
SELECT path, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'text' WHEN t = 'BOOLEAN' THEN 'flag'
                  WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'list' ELSE 'null' END AS kind, count(*) AS n
FROM t WHERE t IS NOT NULL GROUP BY ALL""")
def payload_keys(spark, d):
    """every path of the events' payloads with the kinds of its values."""
    return pl.payload_keys(_payloads(spark, d), "payload")


@query("payload_summary", f"""
WITH p AS (SELECT {_PAYLOAD} AS j FROM events)
SELECT count(*) AS n_rows, count(*) - count(j) AS n_missing, count(CASE WHEN j IS NOT NULL AND NOT json_valid(j) THEN 1 END) AS n_malformed
FROM p""")
def payload_summary(spark, d):
    """missing and malformed payloads."""
    return pl.payload_summary(_payloads(spark, d), "payload").drop("schema")


@query("payload_fields", f"""
WITH p AS (SELECT event_id, {_PAYLOAD} AS j FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM p)
SELECT event_id, TRY_CAST(json_extract_string(j, '$.who.id') AS BIGINT) AS who_id, json_extract_string(j, '$.who.tags[0]') AS first_tag FROM v""")
def payload_fields(spark, d):
    """nested fields as typed columns."""
    return pl.with_fields(_payloads(spark, d), "payload", {"who_id": ("$.who.id", "bigint"), "first_tag": ("$.who.tags[0]", "string")}).drop("payload")


@query("log_shift", """
WITH m AS (SELECT min(c_acctbal) AS mn FROM customer)
SELECT c_custkey, round((ln(1 + c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0 END)) + sign((ln(1 + c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0 END))) * 1e-9, 6) AS c_acctbal_log
FROM customer, m""")
def log_shift(spark, d):
    """log(1 + x) with the shift that makes the minimum positive."""
    from tessera.operators.prepare import fit_scaler
    cu = load(spark, d, "customer")
    sc = fit_scaler(cu, ["c_acctbal"], "log")
    return round_doubles(sc.transform(cu).select("c_custkey", F.col("c_acctbal").alias("c_acctbal_log")))


@query("null_report_events", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT 'value' AS column_name, CAST(count(*) - count(value) AS BIGINT) AS null_count FROM e""")
def null_report_events(spark, d):
    """S1 normalisation check: injected nulls are counted as nulls."""
    p = prof.profile(_events_with_nulls(spark, d).select("value"))
    return p.select("column_name", "null_count")


@query("suggest_names", """
SELECT 'o_orderkey_id' AS "column", 'bigint' AS current_dtype, 'string' AS suggested_dtype,
       'o_orderkey_id: the name speaks of a key, with which nobody calculates' AS reason
UNION ALL SELECT 'ship_date_text', 'string', 'datetime',
       'ship_date_text: the name speaks of a point in time, the type is string'
UNION ALL SELECT 'is_returned', 'double', 'boolean',
       'is_returned: a yes-or-no name over whole numbers'""")
def suggest_names(spark, d):
    """Name + sample hints over the profile (A1 + A2) of derived columns."""
    li = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date_text"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("is_returned"),
        "l_extendedprice")
    return dty.suggest_from_names(prof.profile_with_samples(li))


@query("detect_date", """
WITH l AS (SELECT strftime(l_shipdate, '%m/%d/%Y') AS ship_date FROM lineitem),
probe AS (SELECT ship_date FROM l WHERE ship_date IS NOT NULL)
SELECT CASE WHEN (SELECT count(*) FROM probe WHERE try_strptime(ship_date, '%m/%d/%Y') IS NOT NULL)
                 = (SELECT count(*) FROM probe) AND (SELECT count(*) FROM probe) > 0
            THEN 'ship_date' END AS date_column,
       (SELECT count(*) FROM l) AS n_rows""")
def detect_date(spark, d):
    """The date column used by a temporal split (first timestamp column,
    else a date-named text column all of whose values parse)."""
    li = load(spark, d, "lineitem").select(
        "l_orderkey", F.date_format("l_shipdate", "MM/dd/yyyy").alias("ship_date"), "l_quantity")
    found = dty.detect_date_column(li)
    return li.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(found).alias("date_column"), "n_rows")
