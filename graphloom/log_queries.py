"""Queries of the change log, writes and access over the driver's tables, with SQL where it can say it.

``events`` is read as a log of operations on users: a signup begins a node, an
error ends it, a purchase hands it on to another site, views and clicks set
properties (every second click takes one away).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph_queries import _edges, _t
from graphloom.operators import access as X
from graphloom.operators import jobs as J
from graphloom.operators import mutations as M
from graphloom.sources.schema import Edge, NodeType, Property
from graphloom.streaming import changes as C
from graphloom.streaming import watch as V


def event_log(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("bigint").alias("amount"), F.get_json_object("props", "$.k").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    ops = {"signup": "NodeCreate", "view": "NodeUpdate", "click": "NodeUpdate", "error": "NodeDelete", "purchase": "OwnershipTransfer"}
    op = F.create_map(*[F.lit(x) for kv in ops.items() for x in kv])[F.col("event_type")]
    pair = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("string").alias("value"))
    amount, k = pair("amount", F.col("amount")), pair("k", F.col("k"))
    props = F.when(F.col("event_type") == "signup", F.array(amount, k)).when(F.col("event_type") == "view", F.array(k)).when((F.col("event_type") == "click") & (F.col("amount") % 2 == 0), F.array(amount, pair("k", F.lit(None)))).when(F.col("event_type") == "click", F.array(amount))
    none = F.lit(None).cast("string")
    return e.select(F.col("event_id").alias("version"), (F.col("event_id") % 3).cast("int").alias("site"), "ts", op.alias("op"), F.lit("User").alias("type"), F.col("user_id").alias("id"), none.alias("label"), none.alias("dst_type"), none.cast("bigint").alias("dst_id"), F.coalesce(F.map_from_entries(props), F.create_map().cast("map<string,string>")).alias("props"))


def cdc_after(spark, d):
    """The first 200 entries of one site behind a version."""
    return C.read_after(event_log(spark, d), "version", 300, 200, ("site", 2)).select("version", "op", "id")


def cdc_merge(spark, d):
    """The nodes that the log leaves, properties merged and taken away."""
    return C.fold_nodes(event_log(spark, d)).select("id", "site", F.col("props")["amount"].cast("bigint").alias("amount"), F.col("props")["k"].alias("k"), F.size("props").alias("n"))


def cdc_merge_as_of(spark, d):
    return C.fold_nodes(event_log(spark, d), as_of=700).select("id", F.col("props")["amount"].cast("bigint").alias("amount"))


def watch_ops(spark, d):
    """Events of a watch over nodes whose properties are merged from the log."""
    states = V.states(event_log(spark, d), {"amount": "bigint", "k": "bigint"})
    return C.transitions(states, ["type", "id"], "version", "amount >= 100 && k != null", "op").select("version", "id", "op", "event")


def watch_one_property(spark, d):
    """Operations on one node, updates only where they touch a property."""
    return V.watch_point(event_log(spark, d), "User", 7, ["amount"]).select("version", "op", "event")


def watch_all(spark, d):
    return V.watch_namespace(event_log(spark, d)).groupBy("op", "event").agg(F.count("*").alias("n"))


def watch_snapshot(spark, d):
    nodes = C.fold_nodes(event_log(spark, d), as_of=700).select("type", "id", F.col("props")["amount"].cast("bigint").alias("amount"))
    return V.snapshot_events(nodes, "amount >= 50")


def retention_by_consumers(spark, d):
    """Entries go that are older than five days before the last and that all of three consumers have read."""
    log = event_log(spark, d).select("version", "ts")
    last, most = log.agg(F.max("ts"), F.max("version")).first()
    readers = spark.createDataFrame([("a", most), ("b", most * 2 // 3), ("c", most * 3 // 4)], "consumer string, position long")
    return J.retain_log(log, "version", "ts", last - 5 * 86_400_000_000, readers)


def apply_replica(spark, d):
    """What the entries of three sites leave by the conflict rule (no SQL: each entry depends on the one before)."""
    return M.apply_replica(event_log(spark, d)).select("id", "site", "updated_at", "live", "applied", "ignored", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props")))).alias("props"))


_CUSTOMER = NodeType("Customer", {"c_name": Property("string", True, "unique"), "c_acctbal": Property("float", index="range"), "c_mktsegment": Property("string", True, default="NONE")}, {"PLACED": Edge("Order")})


def _customers(spark, d) -> DataFrame:
    """Customers as nodes of the state of a log; those of the first nations are owned elsewhere."""
    c = _t(spark, d, "customer")
    props = F.create_map(F.lit("c_name"), "c_name", F.lit("c_mktsegment"), "c_mktsegment")
    return c.select(F.lit("Customer").alias("type"), F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 5, 2).otherwise(1).alias("site"), F.lit(0).cast("bigint").alias("updated_at"), props.alias("props"))


def create_customers(spark, d):
    """Suppliers asked to be customers: some lack a name, and some have a customer's."""
    wanted = _t(spark, d, "supplier").select(F.when(F.col("s_acctbal") >= 0, F.when(F.col("s_nationkey") == 3, F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).otherwise(F.col("s_name"))).alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    out = M.create_nodes(wanted, _CUSTOMER, _customers(spark, d), ["c_name"], 1000, 1, 5)
    return out.log.select("version", "id", F.col("props")["c_name"].alias("name"), F.col("props")["c_mktsegment"].alias("segment"), F.lit("").alias("errors")).unionByName(out.rejected.select(F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.array_join("errors", ",").alias("errors")))


def update_customers(spark, d):
    """A new segment for customers in debt; two in a hundred ids are of nobody, and some customers another site's."""
    wanted = _t(spark, d, "customer").where("c_acctbal < 0").select(F.when(F.col("c_acctbal") < -900, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("id"), F.create_map(F.lit("c_mktsegment"), F.when(F.col("c_acctbal") > -500, F.lit("DEBT"))).alias("changed"))
    out = M.update_nodes(wanted, _CUSTOMER, _customers(spark, d), 0, 1, 5)
    return out.log.select("id", F.col("props")["c_mktsegment"].alias("segment"), F.lit("").alias("errors")).unionByName(out.rejected.select("id", F.col("changed")["c_mktsegment"].alias("segment"), F.array_join("errors", ",").alias("errors")))


def delete_customers(spark, d):
    """Deleting customers in debt: an entry for each, and one for each of their orders' edges."""
    gone = _t(spark, d, "customer").where("c_acctbal < 0").select(F.lit("Customer").alias("type"), F.col("c_custkey").alias("id"))
    edges = _edges(_t(spark, d, "orders"), "Customer", "o_custkey", "PLACED", "Order", "o_orderkey")
    return M.delete_nodes(gone, _customers(spark, d), edges, 1, 1, 5).log.select("op", "type", "id", "dst_id")


def place_orders(spark, d):
    """Edges to orders: of owned customers they are written, else turned down."""
    orders = _t(spark, d, "orders")
    nodes = _customers(spark, d).select("type", "id", "site").unionByName(orders.where("o_orderstatus <> 'P'").select(F.lit("Order").alias("type"), F.col("o_orderkey").alias("id"), F.lit(1).alias("site")))
    wanted = _edges(orders, "Customer", "o_custkey", "PLACED", "Order", "o_orderkey").withColumn("props", F.create_map().cast("map<string,string>"))
    out = M.create_edges(wanted, {"Customer": _CUSTOMER}, nodes, 0, 1, 5)
    return out.log.select("id", "dst_id", F.lit("").alias("errors")).unionByName(out.rejected.select(F.col("src_id").alias("id"), "dst_id", F.array_join("errors", ",").alias("errors")))


def transfer_customers(spark, d):
    wanted = _t(spark, d, "customer").where("c_acctbal > 9000").select(F.lit("Customer").alias("type"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 9500, 1).otherwise(3).alias("to"))
    out = M.transfer_ownership(wanted, _customers(spark, d), 0, 1, 5)
    return out.log.select("id", "site", F.lit("").alias("errors")).unionByName(out.rejected.select("id", F.col("to").alias("site"), F.array_join("errors", ",").alias("errors")))


def permitted_events(spark, d):
    """Events as requests of their users for a path, held against policies with wildcards."""
    asked = _t(spark, d, "events").select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("principal"), F.concat_ws("/", F.lit("db"), F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")), "event_type").alias("resource"), F.when(F.col("value") > 100, "write").otherwise("read").alias("action"))
    rules = spark.createDataFrame([("u0", "db/*/click", ["*"]), ("u1", "db/+", ["read"]), ("u2", "db/ns1/*", ["read", "write"]), ("u2", "db/*", ["*"]), ("u3", "db.ns1/view", ["*"])], "principal string, resource string, actions array<string>")
    return X.permitted(asked, rules).select("event_id", "allowed")


def audit_events(spark, d):
    """The last purchases of large values between two days, as an audit query."""
    e = _t(spark, d, "events").select("event_id", "ts", F.when(F.col("value") > 100, "large").otherwise("small").alias("principal"), F.col("event_type").alias("action"))
    return X.audit(e, "large", "purchase", datetime(2024, 1, 5), datetime(2024, 1, 20), 100)


QUERIES = {f.__name__: f for f in (cdc_after, cdc_merge, cdc_merge_as_of, watch_ops, watch_one_property, watch_all, watch_snapshot, retention_by_consumers, apply_replica, create_customers, update_customers, delete_customers, place_orders, transfer_customers, permitted_events, audit_events)}

_LOG = "e AS (SELECT event_id AS v, user_id AS id, event_type AS t, CAST(floor(value) AS BIGINT) AS amount, json_extract_string(props, '$.k') AS k FROM events), "
_MERGED = "b AS (SELECT id, max(v) AS since FROM e WHERE t IN ('signup', 'error') {w} GROUP BY id), l AS (SELECT b.id, since FROM b JOIN e ON v = since WHERE t = 'signup'), a AS (SELECT l.id, arg_max(amount, v) AS amount FROM l JOIN e ON e.id = l.id AND v >= since WHERE t IN ('signup', 'click') {w} GROUP BY l.id)"
_LAST_K = ", k AS (SELECT l.id, CASE WHEN t <> 'click' THEN k END AS k FROM l JOIN e ON e.id = l.id AND v >= since WHERE t IN ('signup', 'view') OR t = 'click' AND amount % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY v DESC) = 1), o AS (SELECT id, arg_max(v % 3, v) AS site FROM e WHERE t IN ('signup', 'purchase') GROUP BY id)"
ORACLE_SQL = {
    "cdc_after": "SELECT event_id AS version, CASE event_type WHEN 'signup' THEN 'NodeCreate' WHEN 'error' THEN 'NodeDelete' WHEN 'purchase' THEN 'OwnershipTransfer' ELSE 'NodeUpdate' END AS op, user_id AS id FROM events WHERE event_id > 300 AND event_id % 3 = 2 ORDER BY event_id LIMIT 200",
    "cdc_merge": "WITH " + _LOG + _MERGED.format(w="") + _LAST_K + " SELECT a.id, CAST(site AS INTEGER) AS site, amount, k.k, CAST(1 + (k.k IS NOT NULL)::INT AS INTEGER) AS n FROM a JOIN k ON k.id = a.id JOIN o ON o.id = a.id",
    "cdc_merge_as_of": "WITH " + _LOG + _MERGED.format(w="AND v <= 700") + " SELECT id, amount FROM a",
    "watch_ops": "WITH " + _LOG.removesuffix(", ") + ", f AS (SELECT *, sum((t IN ('signup', 'error'))::INT) OVER (PARTITION BY id ORDER BY v) AS life FROM e), s AS (SELECT v, id, t, last_value(CASE WHEN t IN ('signup', 'click') THEN amount END IGNORE NULLS) OVER (PARTITION BY id, life ORDER BY v) AS amount, last_value(CASE WHEN t IN ('signup', 'view') THEN coalesce(k, '-') WHEN t = 'click' AND amount % 2 = 0 THEN '-' END IGNORE NULLS) OVER (PARTITION BY id, life ORDER BY v) AS k FROM f), m AS (SELECT *, CASE WHEN t IN ('signup', 'view', 'click') THEN coalesce(amount >= 100 AND k <> '-', false) WHEN t = 'error' THEN false END AS now FROM s), w AS (SELECT *, coalesce(last_value(now IGNORE NULLS) OVER (PARTITION BY id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM m), x AS (SELECT v AS version, id, CASE t WHEN 'signup' THEN 'NodeCreate' WHEN 'error' THEN 'NodeDelete' WHEN 'purchase' THEN 'OwnershipTransfer' ELSE 'NodeUpdate' END AS op, CASE WHEN t = 'error' AND was THEN 'DELETE' WHEN t = 'purchase' AND was THEN 'UPDATE' WHEN now AND NOT was THEN 'ENTER' WHEN now THEN 'UPDATE' WHEN NOT now AND was THEN 'EXIT' END AS event FROM w) SELECT * FROM x WHERE event IS NOT NULL",
    "watch_one_property": "SELECT event_id AS version, CASE event_type WHEN 'signup' THEN 'NodeCreate' WHEN 'error' THEN 'NodeDelete' WHEN 'purchase' THEN 'OwnershipTransfer' ELSE 'NodeUpdate' END AS op, CASE event_type WHEN 'signup' THEN 'ENTER' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event FROM events WHERE user_id = 7 AND event_type <> 'view'",
    "watch_all": "SELECT CASE event_type WHEN 'signup' THEN 'NodeCreate' WHEN 'error' THEN 'NodeDelete' WHEN 'purchase' THEN 'OwnershipTransfer' ELSE 'NodeUpdate' END AS op, CASE event_type WHEN 'signup' THEN 'ENTER' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event, count(*) AS n FROM events GROUP BY ALL",
    "watch_snapshot": "WITH " + _LOG + _MERGED.format(w="AND v <= 700") + " SELECT 'User' AS type, id, 'ENTER' AS event, 'initial_snapshot' AS reason FROM a WHERE amount >= 50",
    "retention_by_consumers": "WITH m AS (SELECT max(ts) - INTERVAL 5 DAYS AS cut, max(event_id) * 2 // 3 AS least FROM events) SELECT event_id AS version, epoch_us(ts) AS ts FROM events, m WHERE NOT (ts < cut AND event_id < least)",
    "create_customers": "WITH w AS (SELECT CASE WHEN s_acctbal >= 0 THEN CASE WHEN s_nationkey = 3 THEN replace(s_name, 'Supplier', 'Customer') ELSE s_name END END AS name FROM supplier), x AS (SELECT name, CASE WHEN name IS NULL THEN 'required:c_name' WHEN name IN (SELECT c_name FROM customer) THEN 'unique:c_name' ELSE '' END AS errors FROM w), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM x WHERE errors = '') SELECT 1000 + n AS version, (SELECT max(c_custkey) FROM customer) + 1 + n AS id, name, 'NONE' AS segment, '' AS errors FROM n UNION ALL SELECT NULL, NULL, name, 'NONE', errors FROM x WHERE errors <> ''",
    "update_customers": "WITH w AS (SELECT CASE WHEN c_acctbal < -900 THEN -c_custkey - 1 ELSE c_custkey END AS id, CASE WHEN c_acctbal > -500 THEN 'DEBT' END AS segment, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0) SELECT id, segment, CASE WHEN c_acctbal < -900 THEN 'missing' WHEN c_nationkey < 5 THEN 'owner' ELSE '' END AS errors FROM w",
    "delete_customers": "SELECT 'NodeDelete' AS op, 'Customer' AS type, c_custkey AS id, NULL::BIGINT AS dst_id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'EdgeDelete', 'Customer', o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "place_orders": "SELECT o_custkey AS id, o_orderkey AS dst_id, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'source' END, CASE WHEN coalesce(o_orderstatus, 'P') = 'P' THEN 'destination' END, CASE WHEN c_nationkey < 5 THEN 'owner' END) AS errors FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "transfer_customers": "SELECT c_custkey AS id, CASE WHEN c_acctbal > 9500 THEN 1 ELSE 3 END AS site, CASE WHEN c_nationkey < 5 THEN 'owner' ELSE '' END AS errors FROM customer WHERE c_acctbal > 9000 AND (c_nationkey < 5 OR c_acctbal <= 9500)",
    "permitted_events": "SELECT event_id, CASE user_id % 4 WHEN 0 THEN event_type = 'click' WHEN 1 THEN value <= 100 WHEN 2 THEN user_id % 3 = 1 ELSE false END AS allowed FROM events",
    "audit_events": "SELECT event_id, ts, 'large' AS principal, 'purchase' AS action FROM events WHERE value > 100 AND event_type = 'purchase' AND ts BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY ts LIMIT 100",
}
