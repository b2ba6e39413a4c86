"""Queries for tracking tables, lineage, rules and streams (L, T, W3-W7, P6-P10, R, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as prof
from tessera.operators import rules as ru
from tessera.operators import tracking as tr
from tessera.plans.q_ingest import EVENTS_NULLS_SQL, _events_with_nulls
from tessera.plans.registry import load, query, round_doubles
from tessera.session import scratch_path
from tessera.streaming import events as st


def _entity_edges(spark, d):
    """Dependency edges upstream → downstream between entity rows:
    region → nation → customer → order."""
    n = load(spark, d, "nation").select(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("src"),
                                        F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("dst"))
    c = load(spark, d, "customer").select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("src"),
                                          F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("dst"))
    o = load(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src"),
                                        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("dst"))
    return n.unionByName(c).unionByName(o)


_EDGES_SQL = """
edges AS (SELECT 'r:' || CAST(n_regionkey AS VARCHAR) AS src, 'n:' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
  UNION ALL SELECT 'n:' || CAST(c_nationkey AS VARCHAR), 'c:' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c:' || CAST(o_custkey AS VARCHAR), 'o:' || CAST(o_orderkey AS VARCHAR) FROM orders)"""


@query("lineage_closure", f"""
WITH RECURSIVE {_EDGES_SQL},
walk(node, depth) AS (SELECT 'r:' || CAST(r_regionkey AS VARCHAR), 0 FROM region WHERE r_name = 'EUROPE'
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def lineage_closure(spark, d):
    """Everything downstream of a changed region (nations, customers,
    orders), by iterative joins until no new node."""
    changed = load(spark, d, "region").where(F.col("r_name") == "EUROPE").select(
        F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node"))
    return tr.lineage_closure(_entity_edges(spark, d), changed)


@query("provenance", f"""
WITH RECURSIVE {_EDGES_SQL},
walk(start_id, id, depth) AS (SELECT 'o:' || CAST(o_orderkey AS VARCHAR), 'o:' || CAST(o_orderkey AS VARCHAR), 0 FROM orders
  UNION ALL SELECT w.start_id, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id)
SELECT start_id, id, CAST(depth AS INTEGER) AS depth FROM walk""")
def provenance(spark, d):
    """The chain from every order up to its root region."""
    nodes = _entity_edges(spark, d).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    start = load(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return tr.provenance_chain(nodes, "id", "parent", start)


@query("mark_stale", f"""
WITH RECURSIVE {_EDGES_SQL},
walk(node, depth) AS (SELECT 'r:' || CAST(r_regionkey AS VARCHAR), 0 FROM region WHERE r_name = 'EUROPE'
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node),
c AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
s AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS node,
             CASE WHEN c_acctbal > 0 THEN 'completed' ELSE 'pending' END AS state FROM customer)
SELECT s.node, CASE WHEN c.depth = 0 THEN 'ready' WHEN c.depth IS NOT NULL AND s.state = 'completed' THEN 'stale'
                    ELSE s.state END AS state
FROM s LEFT JOIN c ON s.node = c.node""")
def mark_stale(spark, d):
    """Finished customers downstream of the changed region become stale."""
    changed = load(spark, d, "region").where(F.col("r_name") == "EUROPE").select(
        F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node"))
    closure = tr.lineage_closure(_entity_edges(spark, d), changed)
    states = load(spark, d, "customer").select(
        F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"),
        F.when(F.col("c_acctbal") > 0, "completed").otherwise("pending").alias("state"))
    return tr.mark_stale(states, closure)


@query("versions", """
SELECT event_id, user_id, event_type,
       CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS version FROM events""")
def versions(spark, d):
    """Version numbers per (session, step) in time order."""
    ev = load(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return tr.with_versions(ev, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("latest_version", """
SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS value
FROM events GROUP BY 1, 2""")
def latest_version(spark, d):
    """Latest entry per (session, step)."""
    ev = load(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return tr.latest_per_group(ev, ["user_id", "event_type"], "ts")


@query("runs_ranked", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, value,
       CAST(rank() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0.0) DESC) AS INTEGER) AS rank FROM e""")
def runs_ranked(spark, d):
    """Runs ranked per session by a metric, missing metric = 0."""
    ev = _events_with_nulls(spark, d).select("event_id", "user_id", "value")
    return tr.rank_by_metric(ev, ["user_id"], "value")


@query("best_run", f"""
WITH e AS ({EVENTS_NULLS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0.0) DESC, event_id DESC) AS rn FROM e)
SELECT user_id, event_id, event_type, value FROM r WHERE rn = 1""")
def best_run(spark, d):
    """T4/L3/L4: best run (model) per session (ties to the latest id)."""
    ev = _events_with_nulls(spark, d).select("user_id", "event_id", "event_type", "value")
    return tr.best_by(ev, ["user_id"], "value", ["event_id"])


@query("page_events", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_id, ts, user_id, event_type, value, props, CAST(rn AS INTEGER) AS position
FROM r WHERE rn > 10 AND rn <= 60""")
def page_events(spark, d):
    """The second page (offset 10, limit 50) of every session's events, newest first."""
    return tr.paginate(load(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 10, 50, ["user_id"])


@query("retention", """
WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
now_ AS (SELECT max(ts) AS now FROM events)
SELECT e.user_id, count(*) AS n_files FROM events e, now_
WHERE e.ts < now - INTERVAL 7 DAY AND e.user_id IN (SELECT user_id FROM done) GROUP BY 1""")
def retention(spark, d):
    """Per completed session (one with a purchase), events older than
    7 days before the newest event."""
    ev = load(spark, d, "events")
    sessions = ev.groupBy("user_id").agg(F.max(F.col("event_type") == "purchase").alias("completed"))
    now = ev.agg(F.max("ts").cast("string")).first()[0]
    # a wall-clock literal of the same type as ts: no session time zone involved
    return tr.retention(ev, sessions, "user_id", "ts", "completed", F.lit(now).cast("timestamp_ntz"), 7)


@query("register_if_changed", """
WITH reg AS (SELECT user_id, event_type, ts, props FROM events WHERE event_id % 2 = 0),
latest AS (SELECT user_id, event_type, arg_max(props, ts) AS props FROM reg GROUP BY 1, 2),
cand AS (SELECT user_id, event_type, arg_max(props, ts) AS props, max(ts) AS ts
         FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = c.user_id
  AND l.event_type = c.event_type AND l.props = c.props)""")
def register_if_changed(spark, d):
    """L2: register only entries whose path differs from the latest one of
    their (session, type) — even events act as the registry, odd ones as
    new candidates."""
    ev = load(spark, d, "events")
    reg = ev.where(F.col("event_id") % 2 == 0).select("user_id", "event_type", "ts", "props")
    cand = tr.latest_per_group(ev.where(F.col("event_id") % 2 == 1).select("user_id", "event_type", "props", "ts"),
                               ["user_id", "event_type"], "ts")
    return tr.register_if_changed(reg, cand, ["user_id", "event_type"], "ts", "props")


@query("search_text", """
SELECT doc_id, lang, source FROM documents
WHERE contains(lower(concat_ws(' ', coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))), 'data')""")
def search_text(spark, d):
    """Case-insensitive search over concatenated fields (whole texts), newest id first."""
    docs = load(spark, d, "documents")
    return tr.search_text(docs, ["lang", "source", "text"], "data", [F.desc("doc_id")]).select(
        "doc_id", "lang", "source")


@query("filter_status", """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def filter_status(spark, d):
    """Optional equality predicates."""
    return tr.filter_eq(load(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)


@query("derive_target", """
SELECT *, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big_order FROM orders""")
def derive_target(spark, d):
    """Target derived by a SQL expression."""
    return ru.derive_column(load(spark, d, "orders"), "big_order",
                            "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END")


@query("identify_target", """
SELECT CASE WHEN (SELECT count(DISTINCT quality) FROM labels) = 2 THEN 'quality'
            WHEN (SELECT count(DISTINCT toxic) FROM labels) = 2 THEN 'toxic' END AS target,
       'two_valued' AS reason""")
def identify_target(spark, d):
    """The target of the labels table (no known name; first two-valued column)."""
    return ru.identify_target(load(spark, d, "labels").select("doc_id", "quality", "toxic"))


@query("keyword_columns", """
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name FROM information_schema.columns
WHERE table_name = 'lineitem' AND regexp_matches(lower(column_name), 'price|quantity|date')""")
def keyword_columns(spark, d):
    """P10: profile rows whose names carry a keyword."""
    p = prof.profile(load(spark, d, "lineitem"))
    return ru.keyword_columns(p, ["price", "quantity", "date"]).select("position", "column_name")


def _listing_sql() -> str:
    from tessera.plans.q_ingest import profile_sql
    cols = [("l_quantity", "double", "num"), ("l_extendedprice", "double", "num"), ("l_discount", "double", "num"),
            ("l_tax", "double", "num"), ("l_returnflag", "string", "str")]
    prof_sql = profile_sql("lineitem", cols)
    return f"""
WITH p AS ({prof_sql}),
imp AS (SELECT 'l_quantity' AS f, least(round((abs(corr(l_quantity, l_extendedprice))) + sign((abs(corr(l_quantity, l_extendedprice)))) * 1e-6, 3), 1.0) AS s FROM lineitem
  UNION ALL SELECT 'l_discount', least(round((abs(corr(l_discount, l_extendedprice))) + sign((abs(corr(l_discount, l_extendedprice)))) * 1e-6, 3), 1.0) FROM lineitem
  UNION ALL SELECT 'l_tax', least(round((abs(corr(l_tax, l_extendedprice))) + sign((abs(corr(l_tax, l_extendedprice)))) * 1e-6, 3), 1.0) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 0.3)
SELECT p.*, coalesce(imp.s, 0.5) AS importance, CAST(NULL AS VARCHAR) AS description,
       p.column_name IN ('l_quantity', 'l_discount') AS selected
FROM p LEFT JOIN imp ON p.column_name = imp.f"""


@query("feature_listing", _listing_sql())
def feature_listing(spark, d):
    """Profile joined with importance (default 0.5) and selection."""
    from tessera.operators.explore import feature_ranking
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    imp = feature_ranking(li, "l_extendedprice")
    return round_doubles(ru.feature_listing(prof.profile(li), imp, selected=["l_quantity", "l_discount"]))


@query("feature_screen", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
                  o_totalprice * 1.05 AS price_with_tax, 'x' AS constant_col FROM orders),
p AS (
  SELECT 'o_orderkey' AS c, 'bigint' AS t, count(DISTINCT o_orderkey) AS u, count(*) - count(o_orderkey) AS nn,
         abs(corr(o_orderkey, o_totalprice)) AS tc FROM o
  UNION ALL SELECT 'o_custkey', 'bigint', count(DISTINCT o_custkey), count(*) - count(o_custkey),
         abs(corr(o_custkey, o_totalprice)) FROM o
  UNION ALL SELECT 'o_totalprice', 'double', count(DISTINCT o_totalprice), count(*) - count(o_totalprice), NULL FROM o
  UNION ALL SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), NULL FROM o
  UNION ALL SELECT 'o_orderpriority', 'string', count(DISTINCT o_orderpriority), count(*) - count(o_orderpriority), NULL FROM o
  UNION ALL SELECT 'price_with_tax', 'double', count(DISTINCT price_with_tax), count(*) - count(price_with_tax),
         abs(corr(price_with_tax, o_totalprice)) FROM o
  UNION ALL SELECT 'constant_col', 'string', count(DISTINCT constant_col), count(*) - count(constant_col), NULL FROM o),
d AS (SELECT abs(corr(o_orderkey, o_custkey)) AS kc, abs(corr(o_orderkey, price_with_tax)) AS kp,
             abs(corr(o_custkey, price_with_tax)) AS cp FROM o),
n AS (SELECT count(*) AS n FROM o),
r AS (SELECT c, CASE
    WHEN c = 'o_totalprice' THEN 'target'
    WHEN lower(c) IN ('id', 'customerid', 'customer_id', 'index', 'row_number') THEN 'identifier'
    WHEN nn * 100.0 / n > 60 THEN 'too many nulls'
    WHEN u <= 1 THEN 'single value'
    WHEN t = 'string' AND u > 0.9 * n THEN 'high-cardinality text'
    WHEN tc > 0.95 THEN 'leakage'
    WHEN (c = 'o_custkey' AND kc > 0.98) OR (c = 'price_with_tax' AND (kp > 0.98 OR cp > 0.98)) THEN 'near-duplicate'
    END AS reason FROM p, d, n)
SELECT c AS column_name, reason IS NULL AS keep, coalesce(reason, '') AS reason FROM r""")
def feature_screen(spark, d):
    """Keep / drop with reasons over orders ⋈ a leaky copy of the total."""
    o = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        (F.col("o_totalprice") * 1.05).alias("price_with_tax"), F.lit("x").alias("constant_col"))
    return ru.screen_features(o, "o_totalprice")


# ---- streams ---------------------------------------------------------------

def _stream(spark, d):
    schema = load(spark, d, "events").schema
    return st.event_stream(spark, d, schema, "events.parquet")


@query("stream_append", "SELECT * FROM events")
def stream_append(spark, d):
    """Events streamed into a Parquet sink (availableNow), read back."""
    sink = scratch_path(spark, "events-sink")
    st.append_events(_stream(spark, d), sink, sink + "-ckpt")
    return spark.read.schema(load(spark, d, "events").schema).parquet(sink)


@query("stream_last_n", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_id, ts, user_id, event_type, value, props FROM r WHERE rn <= 5""")
def stream_last_n(spark, d):
    """The last five events per session, kept as keyed state by a resumable streaming job."""
    root = scratch_path(spark, "last-n")
    st.last_n_per_key(_stream(spark, d), "user_id", ["ts", "event_id"], 5, root)
    return st.read_keyed(spark, root, ["user_id"]).select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("stream_state", """
SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts, count(*) AS n_events FROM events GROUP BY 1""")
def stream_state(spark, d):
    """Current state per session from the feed (streaming max_by)."""
    root = scratch_path(spark, "state")
    st.run_keyed(st.current_state(_stream(spark, d), ["user_id"], "ts", "event_type"), root, ["user_id"])
    return st.read_keyed(spark, root, ["user_id"])
