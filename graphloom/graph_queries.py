"""Queries of the graph operators over the driver's tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import aggregate as A
from graphloom.operators import edges as E
from graphloom.operators import jobs as J
from graphloom.operators import nodes as N
from graphloom.operators import traversal as W
from graphloom.streaming import changes as C


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(df: DataFrame, src: str, src_id: str, label: str, dst: str, dst_id: str, *props: str) -> DataFrame:
    return df.select(F.lit(src).alias("src_type"), F.col(src_id).cast("bigint").alias("src_id"), F.lit(label).alias("label"), F.lit(dst).alias("dst_type"), F.col(dst_id).cast("bigint").alias("dst_id"), *props)


def graph(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys as edges."""
    parts = [
        _edges(_t(spark, d, "customer"), "Customer", "c_custkey", "IN_NATION", "Nation", "c_nationkey"),
        _edges(_t(spark, d, "supplier"), "Supplier", "s_suppkey", "IN_NATION", "Nation", "s_nationkey"),
        _edges(_t(spark, d, "nation"), "Nation", "n_nationkey", "IN_REGION", "Region", "n_regionkey"),
        _edges(_t(spark, d, "orders"), "Customer", "o_custkey", "PLACED", "Order", "o_orderkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find_customers(spark, d):
    return N.find(_t(spark, d, "customer"), "c_acctbal >= 5000.0 && c_mktsegment == 'BUILDING'", ["c_custkey", "c_name", "c_acctbal"], limit=None).orderBy("c_custkey")


def find_residual(spark, d):
    return N.find(_t(spark, d, "part"), "(p_size >= 40 || p_brand == 'Brand#1') && p_name.contains('a') && p_retailprice != null", ["p_partkey", "p_size"], limit=None)


def find_in_orders(spark, d):
    return N.find(_t(spark, d, "orders"), "o_orderstatus in ['F', 'P'] && o_totalprice > 1000", ["o_orderkey", "o_orderstatus"], limit=None)


def keyset_page(spark, d):
    return N.find(_t(spark, d, "orders"), "o_totalprice > 100.0", ["o_orderkey", "o_totalprice"], order=["o_orderkey"], limit=50, after=(120,))


def offset_page(spark, d):
    return N.find(_t(spark, d, "orders"), "", ["o_orderkey"], order=["o_orderkey"], limit=20, offset=35)


def range_scan_timestamp(spark, d):
    return N.find(_t(spark, d, "orders"), "o_orderdate >= 820454400000000", ["o_orderkey", "o_custkey"], limit=None)


def expand_out(spark, d):
    own = E.list_edges(graph(spark, d), "OUT", ["PLACED"])
    return own.join(_t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey"), F.col("src_id") == F.col("c_custkey"), "left_semi")


def expand_in(spark, d):
    return E.list_edges(graph(spark, d), "IN", ["IN_NATION"])


def expand_both(spark, d):
    return E.list_edges(graph(spark, d), "BOTH", ["IN_REGION"])


def top_orders(spark, d):
    own = _edges(_t(spark, d, "orders"), "Customer", "o_custkey", "PLACED", "Order", "o_orderkey", "o_totalprice")
    return E.top_edges(own, 3, [F.col("o_totalprice").desc(), F.col("dst_id")]).select("src_id", "dst_id", "o_totalprice")


def _walk(start, edges, hops, nodes=None):
    return W.nodes_of(W.traverse(start, edges, hops, nodes))


def traverse_regions(spark, d):
    start = _t(spark, d, "customer").where("c_acctbal < 0").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))
    return _walk(start, graph(spark, d), [{"labels": ["IN_NATION"]}, {"labels": ["IN_REGION"]}])


def traverse_compatriots(spark, d):
    start = _t(spark, d, "customer").where("c_acctbal < -900 AND c_mktsegment = 'FURNITURE'").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))
    return _walk(start, graph(spark, d), [{"labels": ["IN_NATION"]}, {"labels": ["IN_NATION"], "direction": "IN", "node_filter": "c_acctbal > 0.0"}], {"Customer": (_t(spark, d, "customer"), "c_custkey")})


def _rich_customers(spark, d):
    return _t(spark, d, "customer").where("c_acctbal > 9000 AND c_mktsegment <> 'BUILDING'").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))


def traverse_regions_by_value(spark, d):
    return _walk(_rich_customers(spark, d), graph(spark, d), [{"labels": ["IN_NATION"]}, {"labels": ["IN_REGION"]}])


def traverse_compatriots_by_value(spark, d):
    return _walk(_rich_customers(spark, d), graph(spark, d), [{"labels": ["IN_NATION"]}, {"labels": ["IN_NATION"], "direction": "IN", "node_filter": "c_acctbal > 0.0"}], {"Customer": (_t(spark, d, "customer"), "c_custkey")})


def _rich(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.where("c_acctbal > 3000"), c.where("c_nationkey < 10"), c.where("c_acctbal BETWEEN 0 AND 7000")


def set_union(spark, d):
    return N.union(list(_rich(spark, d)), ["c_custkey"])


def set_intersect(spark, d):
    return N.intersect(list(_rich(spark, d)), ["c_custkey"])


def set_difference(spark, d):
    return N.difference(list(_rich(spark, d)), ["c_custkey"])


def _by_value(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return [x.drop("c_mktsegment") for x in (c.where("c_acctbal > 3000"), c.where("c_nationkey < 10"), c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')"))]


def set_union_by_value(spark, d):
    return N.union(_by_value(spark, d), ["c_custkey"])


def set_intersect_by_value(spark, d):
    return N.intersect(_by_value(spark, d), ["c_custkey"])


def set_difference_by_value(spark, d):
    return N.difference(_by_value(spark, d), ["c_custkey"])


def order_degree(spark, d):
    return E.degree(_t(spark, d, "customer").select("c_custkey"), "c_custkey", E.oriented(graph(spark, d), "OUT", ["PLACED"]))


def group_segments(spark, d):
    return A.group_by(_t(spark, d, "customer"), ["c_mktsegment"], {"n": ("count", "c_acctbal"), "low": ("min", "c_acctbal"), "high": ("max", "c_acctbal")})


def cdc_fold(spark, d):
    return C.fold(_t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


def cdc_as_of(spark, d):
    return C.fold(_t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", as_of=500)


def watch_transitions(spark, d):
    return C.transitions(_t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value >= 50.0").select("user_id", "event_id", "event")


def batch_lookup(spark, d):
    ids = _t(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("id"), F.col("o_orderkey").alias("pos"))
    return N.lookup(_t(spark, d, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


def orphan_edges(spark, d):
    own = _edges(_t(spark, d, "orders"), "Customer", "o_custkey", "PLACED", "Order", "o_orderkey")
    live = _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("src_id"))
    return N.difference([own, live], ["src_id"]).select("src_id", "dst_id")


def duplicate_values(spark, d):
    """Values that break a unique constraint on a customer's nation and segment."""
    return A.duplicate_values(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


def document_frequency(spark, d):
    return A.document_frequency(_t(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])


def log_retention(spark, d):
    """Entries from before 2024-01-20 go, as far as two consumers have read."""
    events = _t(spark, d, "events").select("event_id", "ts")
    readers = events.agg(F.explode(F.array(F.max("event_id"), F.floor(F.max("event_id") / 3))).alias("position"))
    return J.retain_log(events, "event_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), readers)


def log_retention_by_age(spark, d):
    """Entries of more than ten days before the last one go, but for those from the middle version on."""
    events = _t(spark, d, "events").select("event_id", "ts")
    last, checkpoint = events.agg(F.max("ts") - F.expr("INTERVAL 10 DAYS"), F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()
    return C.retain(events, "event_id", "ts", last, checkpoint)


def all_of_terms(spark, d):
    return N.find(_t(spark, d, "documents").select("doc_id", "text"), "allofterms(text, 'the OF') && size(text) > 500", ["doc_id"], limit=None)


QUERIES = {f.__name__: f for f in (find_customers, find_residual, find_in_orders, keyset_page, offset_page, range_scan_timestamp, expand_out, expand_in, expand_both, top_orders, traverse_regions, traverse_compatriots, traverse_regions_by_value, traverse_compatriots_by_value, set_union, set_intersect, set_difference, set_union_by_value, set_intersect_by_value, set_difference_by_value, order_degree, group_segments, cdc_fold, cdc_as_of, watch_transitions, batch_lookup, orphan_edges, duplicate_values, document_frequency, log_retention, log_retention_by_age, all_of_terms)}

_RICH = "WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), x AS (SELECT * FROM c WHERE c_acctbal > 3000), y AS (SELECT * FROM c WHERE c_nationkey < 10), z AS (SELECT * FROM c WHERE c_acctbal BETWEEN 0 AND 7000) "
_BY_VALUE = "WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), x AS (SELECT * FROM c WHERE c_acctbal > 3000), y AS (SELECT * FROM c WHERE c_nationkey < 10), z AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) "
_START = "c_acctbal > 9000 AND c_mktsegment <> 'BUILDING'"
_NATIONS = "SELECT {0} AS src_type, {1} AS src_id, 'IN_NATION' AS label, {2} AS dst_type, {3} AS dst_id FROM {4}"
ORACLE_SQL = {
    "find_customers": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey",
    "find_residual": "SELECT p_partkey, p_size FROM part WHERE (p_size >= 40 OR p_brand = 'Brand#1') AND contains(p_name, 'a') AND p_retailprice IS NOT NULL",
    "find_in_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000",
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100 AND o_orderkey > 120 ORDER BY o_orderkey LIMIT 50",
    "offset_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35",
    "range_scan_timestamp": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= make_timestamp(820454400000000)",
    "expand_out": "SELECT 'Customer' AS src_type, o_custkey AS src_id, 'PLACED' AS label, 'Order' AS dst_type, o_orderkey AS dst_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "expand_in": _NATIONS.format("'Nation'", "CAST(c_nationkey AS BIGINT)", "'Customer'", "c_custkey", "customer") + " UNION ALL " + _NATIONS.format("'Nation'", "CAST(s_nationkey AS BIGINT)", "'Supplier'", "s_suppkey", "supplier"),
    "expand_both": "SELECT 'Nation' AS src_type, CAST(n_nationkey AS BIGINT) AS src_id, 'IN_REGION' AS label, 'Region' AS dst_type, CAST(n_regionkey AS BIGINT) AS dst_id FROM nation UNION ALL SELECT 'Region', CAST(n_regionkey AS BIGINT), 'IN_REGION', 'Nation', CAST(n_nationkey AS BIGINT) FROM nation",
    "top_orders": "SELECT o_custkey AS src_id, o_orderkey AS dst_id, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "traverse_regions": "SELECT DISTINCT 'Region' AS node_type, CAST(n_regionkey AS BIGINT) AS node_id, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0",
    "traverse_compatriots": "SELECT DISTINCT 'Customer' AS node_type, c_custkey AS node_id, 2 AS depth FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900 AND c_mktsegment = 'FURNITURE') AND c_acctbal > 0",
    "set_union": _RICH + "SELECT DISTINCT * FROM (SELECT * FROM x UNION SELECT * FROM y UNION SELECT * FROM z)",
    "set_intersect": _RICH + "SELECT * FROM x WHERE c_custkey IN (SELECT c_custkey FROM y) AND c_custkey IN (SELECT c_custkey FROM z)",
    "set_difference": _RICH + "SELECT * FROM x WHERE c_custkey NOT IN (SELECT c_custkey FROM y) AND c_custkey NOT IN (SELECT c_custkey FROM z)",
    "traverse_regions_by_value": f"SELECT DISTINCT 'Region' AS node_type, CAST(n_regionkey AS BIGINT) AS node_id, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {_START}",
    "traverse_compatriots_by_value": f"SELECT DISTINCT 'Customer' AS node_type, c_custkey AS node_id, 2 AS depth FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE {_START}) AND NOT coalesce({_START}, false) AND c_acctbal > 0",
    "set_union_by_value": _BY_VALUE + "SELECT DISTINCT * FROM (SELECT * FROM x UNION SELECT * FROM y UNION SELECT * FROM z)",
    "set_intersect_by_value": _BY_VALUE + "SELECT * FROM x WHERE c_custkey IN (SELECT c_custkey FROM y) AND c_custkey IN (SELECT c_custkey FROM z)",
    "set_difference_by_value": _BY_VALUE + "SELECT * FROM x WHERE c_custkey NOT IN (SELECT c_custkey FROM y) AND c_custkey NOT IN (SELECT c_custkey FROM z)",
    "order_degree": "SELECT c_custkey, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "group_segments": "SELECT c_mktsegment, count(c_acctbal) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment",
    "cdc_fold": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "cdc_as_of": "SELECT user_id, event_id, event_type, value FROM events WHERE event_id <= 500 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "watch_transitions": "WITH m AS (SELECT user_id, event_id, value >= 50 AS now, coalesce(lag(value >= 50) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM events) SELECT user_id, event_id, CASE WHEN now AND NOT was THEN 'ENTER' WHEN now THEN 'UPDATE' ELSE 'EXIT' END AS event FROM m WHERE now OR was",
    "batch_lookup": "SELECT o_orderkey * 3 AS id, o_orderkey AS pos, c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_orderkey * 3",
    "orphan_edges": "SELECT o_custkey AS src_id, o_orderkey AS dst_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
    "duplicate_values": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "document_frequency": "SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL",
    "log_retention": "SELECT event_id, ts FROM events WHERE NOT (ts < '2024-01-20' AND event_id < (SELECT max(event_id) // 3 FROM events))",
    "log_retention_by_age": "WITH m AS (SELECT max(ts) - INTERVAL 10 DAYS AS cut, floor((min(event_id) + max(event_id)) / 2) AS checkpoint FROM events) SELECT event_id, ts FROM events, m WHERE NOT (ts < cut AND event_id < checkpoint)",
    "all_of_terms": "SELECT doc_id FROM documents WHERE len(text) > 500 AND list_has_all(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), ['the', 'of'])",
}
