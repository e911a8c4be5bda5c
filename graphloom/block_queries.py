"""Queries of filters, paging, paths, aggregates and blocks over the driver's tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.fields import Fields
from graphloom.graph_queries import _edges, _t, graph
from graphloom.operators import aggregate as A
from graphloom.operators import edges as E
from graphloom.operators import nodes as N
from graphloom.operators import traversal as W
from graphloom.plans import blocks as B
from graphloom.sources import schema as S


def _lines(spark, d):
    """Order -CONTAINS-> Part, one edge for each line."""
    return _edges(_t(spark, d, "lineitem"), "Order", "l_orderkey", "CONTAINS", "Part", "l_partkey", "l_linenumber", "l_quantity")


def _graph(spark, d) -> B.Graph:
    own = graph(spark, d).unionByName(_lines(spark, d).drop("l_linenumber"), allowMissingColumns=True)
    return B.Graph({"Customer": (_t(spark, d, "customer"), "c_custkey"), "Supplier": (_t(spark, d, "supplier"), "s_suppkey"), "Nation": (_t(spark, d, "nation"), "n_nationkey"), "Region": (_t(spark, d, "region"), "r_regionkey"), "Order": (_t(spark, d, "orders"), "o_orderkey"), "Part": (_t(spark, d, "part"), "p_partkey")}, own)


# ------------------------------------------------------------ filters


def cel_error_false(spark, d):
    """Comparing text with a number is an error, and its negation no match."""
    return N.find(_t(spark, d, "customer"), "!(c_mktsegment > 5) || !(nope > 5) || c_acctbal < 0.0", ["c_custkey"], limit=None)


def cel_arithmetic(spark, d):
    """Overflow and division by zero are no matches; integers divide to integers."""
    return N.find(_t(spark, d, "orders"), "o_orderkey + 9223372036854775807 > 0 || (o_custkey / 7 == 3 && o_orderkey % 5 != 2) || 1 / (o_orderkey - o_orderkey) == 0", ["o_orderkey"], limit=None)


def cel_functions(spark, d):
    cel = "(p_name.startsWith('red') || p_name.endsWith('ring')) && p_type.matches('^[A-M]') && size(p_brand) > 7 && (p_size > 25 ? p_brand != 'Brand#17' : has(p_retailprice)) && int('7') < p_size && !(size(p_size) > 0)"
    return N.find(_t(spark, d, "part"), cel, ["p_partkey"], limit=None).unionByName(N.find(_t(spark, d, "part"), cel.replace(" && !(size(p_size) > 0)", ""), ["p_partkey"], limit=None))


def typed_filter(spark, d):
    """A filter built by operators on fields."""
    cel = (Fields.c_mktsegment.isin("BUILDING", "MACHINERY") & Fields.c_acctbal.between(1000.0, 2000.0)) | ~Fields.c_name.has()
    return N.find(_t(spark, d, "customer"), cel, ["c_custkey", "c_acctbal"], limit=None)


def quick_filter(spark, d):
    return _t(spark, d, "orders").where(N.quick_filter("o_orderstatus", "!=", "O")).select("o_orderkey")


def term_groups(spark, d):
    """An OR of ANDs of terms, from the postings of two properties."""
    index = N.postings(_t(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])
    return N.by_terms(index, "p_partkey", [[("p_brand", "Brand#2"), ("p_type", "ECONOMY")], [("p_brand", "Brand#17")]])


def composite_terms(spark, d):
    """How many customers each (segment, nation) has, by one term for both."""
    c = _t(spark, d, "customer").withColumn("term", N.composite_term(["c_mktsegment", "c_nationkey"]))
    return A.document_frequency(c, "c_custkey", ["term"])


# ------------------------------------------------------------ scans and pages


def find_first_page(spark, d):
    """The first page: a thousand rows in id order."""
    return N.find(_t(spark, d, "orders"), "", ["o_orderkey"], order=["o_orderkey"])


def keyset_two_keys(spark, d):
    return N.find(_t(spark, d, "orders"), "", ["o_custkey", "o_orderkey"], order=["o_custkey", "o_orderkey"], limit=200, after=(3, 10))


def limit_then_offset(spark, d):
    return N.find(_t(spark, d, "orders"), "", ["o_orderkey"], order=["o_orderkey"], limit=50, offset=35, limit_first=True)


def page_by_cursor(spark, d):
    """The second page, by the cursor of the first."""
    c = _t(spark, d, "customer")
    first = N.page(c, ["c_custkey"], "c_acctbal > 0.0", ["c_acctbal"], size=40)
    return N.page(c, ["c_custkey"], "c_acctbal > 0.0", ["c_acctbal"], size=40, cursor=first.cursor).rows


def scan_by_value(spark, d):
    return N.scan_range(_t(spark, d, "part").select("p_partkey", "p_size"), "p_size", ["p_partkey"], 10, 20, (False, True))


def point_lookup(spark, d):
    return N.get(_t(spark, d, "customer"), c_custkey=42)


# ------------------------------------------------------------ edges and paths


def both_multigraph(spark, d):
    """Edges seen from both ends; lines of an order that name a part twice stay two."""
    own = E.oriented(_lines(spark, d), "BOTH", ["CONTAINS"], "l_quantity >= 45.0 || nope == null")
    return own.groupBy("src_type", "src_id").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def list_edges_ordered(spark, d):
    """A page of adjacency: by source, sort key, far end."""
    own = _lines(spark, d).withColumnRenamed("l_linenumber", "sort_key").drop("l_quantity")
    return E.list_edges(own, "OUT", limit=500, offset=100)


def fan_out_cap(spark, d):
    """At most two lines of each order, those of the smallest line numbers."""
    own = _lines(spark, d).withColumnRenamed("l_linenumber", "sort_key").drop("l_quantity")
    return E.top_edges(own, 2).select("src_id", "sort_key", "dst_id")


def degree_in_both(spark, d):
    own = E.oriented(graph(spark, d), "BOTH", ["IN_NATION", "IN_REGION"])
    return E.degree(_t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n")), "n", own, "Nation")


def _rich(spark, d):
    return _t(spark, d, "customer").where("c_acctbal > 9500").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))


def paths_two_hops(spark, d):
    """Each part that rich customers ordered in number, by the first path to it."""
    hops = [{"labels": ["PLACED"]}, {"labels": ["CONTAINS"], "edge_filter": "l_quantity >= 40.0"}]
    walk = W.traverse(_rich(spark, d), _graph(spark, d).edges, hops)
    return walk.paths.select("node_id", "depth", *[F.col("path")[i]["node_id"].alias(f"at{i}") for i in range(3)], F.col("path")[2]["label"].alias("label"))


def paths_continued(spark, d):
    """The same two hops, stopped after the first and gone on with."""
    own, hops = _graph(spark, d).edges, [{"labels": ["PLACED"]}, {"labels": ["CONTAINS"], "edge_filter": "l_quantity >= 40.0"}]
    walk = W.traverse(_rich(spark, d), own, hops, max_depth=1)
    return W.traverse(_rich(spark, d), own, hops, resume=walk).paths.select("node_id", F.col("path")[1]["node_id"].alias("at1"))


def recurse_four_hops(spark, d):
    """All that is within four steps of suppliers in debt, at its least depth."""
    start = _t(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("Supplier").alias("node_type"), F.col("s_suppkey").alias("node_id"))
    return W.reach(start, graph(spark, d), {"labels": ["IN_NATION", "IN_REGION", "PLACED"], "direction": "BOTH"}, 4)


def cascade_delete(spark, d):
    """The edges that are left when customers in debt are deleted."""
    gone = _t(spark, d, "customer").where("c_acctbal < 0").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))
    return E.without_nodes(graph(spark, d), gone)


def orphans_of_type(spark, d):
    """Edges that hang when only customers with a balance and their orders of one status are nodes."""
    nodes = _t(spark, d, "customer").where("c_acctbal >= 0").select(F.lit("Customer").alias("node_type"), F.col("c_custkey").alias("node_id"))
    nodes = nodes.unionByName(_t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.lit("Order").alias("node_type"), F.col("o_orderkey").alias("node_id")))
    own = _edges(_t(spark, d, "orders"), "Customer", "o_custkey", "PLACED", "Order", "o_orderkey")
    return E.orphans(own, nodes).select("src_id", "dst_id")


# ------------------------------------------------------------ aggregates


def group_orders(spark, d):
    return A.group_by(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": ("count", "o_orderkey"), "total": ("sum", "o_custkey"), "mean": ("avg", "o_custkey"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")})


def above_average(spark, d):
    """Parts above the average size: one block's value in the next one's filter."""
    parts = _t(spark, d, "part")
    return N.find(parts, f"p_size > {A.value_of(parts, 'avg', 'p_size')!r}", ["p_partkey"], limit=None)


def term_frequency(spark, d):
    return A.document_frequency(_t(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def unique_breaks(spark, d):
    return A.duplicate_values(_t(spark, d, "part"), ["p_name", "p_brand"])


def price_percentiles(spark, d):
    got = A.percentiles(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")
    return got.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


def delete_scope(spark, d):
    nodes = _t(spark, d, "nation").select(F.lit("Nation").alias("node_type"), F.col("n_nationkey").cast("bigint").alias("node_id"))
    return A.delete_scope(nodes, graph(spark, d), ["IN_REGION"])


# ------------------------------------------------------------ blocks


def _sets(spark, d, how):
    blocks = [B.Block("all", B.uid_of("rich", "near", "kind", how=how), select=["uid", "c_mktsegment"]), B.Block("rich", B.gt("Customer", "c_acctbal", 3000.0)), B.Block("near", B.lt("Customer", "c_nationkey", 10)), B.Block("kind", B.type_("Customer"), filter="c_mktsegment in ['BUILDING', 'MACHINERY']")]
    return _graph(spark, d).run(blocks)["all"]


def block_union(spark, d):
    """Three blocks, of which the one that joins them stands first."""
    return _sets(spark, d, "union")


def block_intersect(spark, d):
    return _sets(spark, d, "intersect")


def block_difference(spark, d):
    return _sets(spark, d, "difference")


def block_sorted_page(spark, d):
    own = B.Block("b", B.between("Part", "p_size", 10, 20), sort=[("p_retailprice", True)], limit=30, offset=5, select=["uid", "p_size", "p_retailprice"])
    return _graph(spark, d).run([own])["b"]


def block_terms(spark, d):
    """A root of terms, and one of a value that a parameter gives."""
    own = [B.Block("t", B.allofterms("Part", "p_name", "RED ring"), filter="p_type == $kind || p_size >= $least"), B.Block("e", B.eq("Part", "p_brand", "Brand#2"), filter="p_size <= $least"), B.Block("all", B.uid_of("t", "e"), select=["uid"])]
    return _graph(spark, d).run(own, {"kind": "ECONOMY", "least": 30})["all"]


def block_siblings(spark, d):
    """Two selections side by side: a nation's region, and its suppliers in debt."""
    own = B.Block("n", B.has("Nation", "n_name"), expand=[B.Expand(["IN_REGION"]), B.Expand(["IN_NATION"], "IN", filter="s_acctbal < 0.0", target="Supplier")])
    return _graph(spark, d).run([own])["n"].select("root_id", "node_type", "node_id", "via")


def block_nested(spark, d):
    """Hops by nesting; what is arrived at becomes a block."""
    own = [B.Block("c", B.ge("Customer", "c_acctbal", 9900.0), cascade=True, expand=[B.Expand(["PLACED"], filter="o_totalprice > 100000.0", expand=[B.Expand(["CONTAINS"], edge="l_quantity > 30.0", name="parts")])]), B.Block("p", B.uid_of("parts"), select=["uid"])]
    ran = _graph(spark, d).run(own)
    pairs = ran["c"].where("via = 'PLACED>CONTAINS'").groupBy("root_id").agg(F.count("*").alias("n"))
    return pairs.select(F.lit("root").alias("what"), F.col("root_id").alias("id"), "n").unionByName(ran["p"].select(F.lit("part").alias("what"), F.col("uid").alias("id"), F.lit(1).cast("bigint").alias("n")))


def block_cascade(spark, d):
    """Customers with both a large order and a line of many in some order."""
    own = B.Block("c", B.type_("Customer"), cascade=True, expand=[B.Expand(["PLACED"], filter="o_totalprice > 400000.0"), B.Expand(["PLACED"], expand=[B.Expand(["CONTAINS"], edge="l_quantity >= 50.0")])])
    return _graph(spark, d).run([own])["c"].select("root_id").distinct()


def block_top_facets(spark, d):
    """The two lines of most pieces of each order of one customer segment, with the number of pieces."""
    own = B.Block("o", B.gt("Order", "o_totalprice", 450000.0), cascade=True, expand=[B.Expand(["CONTAINS"], sort=[("l_quantity", True)], limit=2, facets=["l_quantity"])])
    return _graph(spark, d).run([own])["o"].select("root_id", "node_id", "l_quantity")


def block_recurse(spark, d):
    """Up to three steps from each region, a node once for each region."""
    own = B.Block("r", B.type_("Region"), recurse=3, expand=[B.Expand(["IN_REGION", "IN_NATION"], "IN")])
    return _graph(spark, d).run([own])["r"].where("node_id IS NOT NULL").groupBy("root_id", "node_type", "via").agg(F.count("*").alias("n"))


def block_point(spark, d):
    own = B.Block("x", B.uid("Nation", 7), expand=[B.Expand(["IN_NATION"], "IN", target="Supplier")])
    return _graph(spark, d).run([own])["x"].select("root_id", "node_id")


def block_groups(spark, d):
    own = B.Block("g", B.le("Customer", "c_acctbal", 5000.0), group_by=["c_mktsegment"], aggregates={"n": ("count", "c_custkey"), "most": ("max", "c_nationkey")})
    return _graph(spark, d).run([own])["g"]


# ------------------------------------------------------------ schema


def validated(spark, d):
    """What is wrong with parts, by a type that asks for more than they have."""
    kind = S.NodeType.parse({"name": "Part", "extras": "reject", "properties": {"p_partkey": {"type": "int", "required": True}, "p_brand": {"type": "string", "index": "unique"}, "p_type": {"type": "int"}, "p_weight": {"type": "float", "required": True}, "p_origin": {"type": "string", "default": "here", "required": True}}})
    own = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_size") > 20, F.col("p_size")).alias("p_size"))
    return S.validate(own, kind).select("p_partkey", "p_origin", F.array_join("errors", ",").alias("errors"))


QUERIES = {f.__name__: f for f in (cel_error_false, cel_arithmetic, cel_functions, typed_filter, quick_filter, term_groups, composite_terms, find_first_page, keyset_two_keys, limit_then_offset, page_by_cursor, scan_by_value, point_lookup, both_multigraph, list_edges_ordered, fan_out_cap, degree_in_both, paths_two_hops, paths_continued, recurse_four_hops, cascade_delete, orphans_of_type, group_orders, above_average, term_frequency, unique_breaks, price_percentiles, delete_scope, block_union, block_intersect, block_difference, block_sorted_page, block_terms, block_siblings, block_nested, block_cascade, block_top_facets, block_recurse, block_point, block_groups, validated)}

_EDGES = "e AS (SELECT 'Customer' AS src_type, c_custkey AS src_id, 'IN_NATION' AS label, 'Nation' AS dst_type, CAST(c_nationkey AS BIGINT) AS dst_id FROM customer UNION ALL SELECT 'Supplier', s_suppkey, 'IN_NATION', 'Nation', s_nationkey FROM supplier UNION ALL SELECT 'Nation', n_nationkey, 'IN_REGION', 'Region', n_regionkey FROM nation UNION ALL SELECT 'Customer', o_custkey, 'PLACED', 'Order', o_orderkey FROM orders)"
_SETS = "WITH x AS (SELECT c_custkey AS uid, c_mktsegment FROM customer WHERE c_acctbal > 3000), y AS (SELECT c_custkey AS uid, c_mktsegment FROM customer WHERE c_nationkey < 10), z AS (SELECT c_custkey AS uid, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) "
_PARTS = "(p_name LIKE 'red%' OR p_name LIKE '%ring') AND regexp_matches(p_type, '^[A-M]') AND len(p_brand) > 7 AND CASE WHEN p_size > 25 THEN p_brand <> 'Brand#17' ELSE p_retailprice IS NOT NULL END AND 7 < p_size"
ORACLE_SQL = {
    "cel_error_false": "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "cel_arithmetic": "SELECT o_orderkey FROM orders WHERE (o_custkey // 7 = 3 AND o_orderkey % 5 <> 2) OR o_orderkey = 0",
    "cel_functions": f"SELECT p_partkey FROM part WHERE {_PARTS}",
    "typed_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 1000 AND 2000 OR c_name IS NULL",
    "quick_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'",
    "term_groups": "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' OR p_brand = 'Brand#17'",
    "composite_terms": "SELECT 'term' AS field, concat(len(c_mktsegment), ':', c_mktsegment, len(CAST(c_nationkey AS VARCHAR)), ':', c_nationkey) AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY ALL",
    "find_first_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000",
    "keyset_two_keys": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (3, 10) ORDER BY o_custkey, o_orderkey LIMIT 200",
    "limit_then_offset": "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) ORDER BY o_orderkey OFFSET 35",
    "page_by_cursor": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 40 OFFSET 40",
    "scan_by_value": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20",
    "point_lookup": "SELECT * FROM customer WHERE c_custkey = 42",
    "both_multigraph": "SELECT src_type, src_id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM (SELECT 'Order' AS src_type, l_orderkey AS src_id, l_linenumber FROM lineitem WHERE l_quantity >= 45 UNION ALL SELECT 'Part', l_partkey, l_linenumber FROM lineitem WHERE l_quantity >= 45) GROUP BY ALL",
    "list_edges_ordered": "SELECT 'Order' AS src_type, l_orderkey AS src_id, 'CONTAINS' AS label, 'Part' AS dst_type, l_partkey AS dst_id, l_linenumber AS sort_key FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500 OFFSET 100",
    "fan_out_cap": "SELECT l_orderkey AS src_id, l_linenumber AS sort_key, l_partkey AS dst_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 2",
    "degree_in_both": f"WITH {_EDGES} SELECT CAST(n_nationkey AS BIGINT) AS n, (SELECT count(*) FROM e WHERE label = 'IN_NATION' AND dst_id = n_nationkey) + 1 AS degree FROM nation",
    "paths_two_hops": "SELECT l_partkey AS node_id, 2 AS depth, o_custkey AS at0, o_orderkey AS at1, l_partkey AS at2, 'CONTAINS' AS label FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 9500 AND l_quantity >= 40 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_custkey, o_orderkey) = 1",
    "paths_continued": "SELECT l_partkey AS node_id, o_orderkey AS at1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 9500 AND l_quantity >= 40 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_custkey, o_orderkey) = 1",
    "recurse_four_hops": f"WITH RECURSIVE {_EDGES}, b AS (SELECT src_type AS t, src_id AS i, dst_type AS t2, dst_id AS i2 FROM e UNION SELECT dst_type, dst_id, src_type, src_id FROM e), r(node_type, node_id, depth) AS (SELECT 'Supplier', s_suppkey, 0 FROM supplier WHERE s_acctbal < 0 UNION SELECT t2, i2, depth + 1 FROM r JOIN b ON t = node_type AND i = node_id WHERE depth < 4) SELECT node_type, node_id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node_type, node_id",
    "cascade_delete": f"WITH {_EDGES} SELECT * FROM e WHERE NOT (src_type = 'Customer' AND src_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))",
    "orphans_of_type": "SELECT o_custkey AS src_id, o_orderkey AS dst_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) OR coalesce(o_orderstatus, '') <> 'O'",
    "group_orders": "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, avg(o_custkey) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL",
    "above_average": "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
    "term_frequency": "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL",
    "unique_breaks": "SELECT p_name, p_brand, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "price_percentiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY o_orderstatus",
    "delete_scope": f"WITH {_EDGES}, n AS (SELECT n_nationkey, count(*) FILTER (label = 'IN_REGION') AS r, count(*) FILTER (label = 'IN_NATION') AS c FROM nation JOIN e ON (src_type = 'Nation' AND src_id = n_nationkey) OR (dst_type = 'Nation' AND dst_id = n_nationkey) GROUP BY n_nationkey) SELECT 'Nation' AS node_type, CAST(n_nationkey AS BIGINT) AS node_id, r + c AS n_edges, 5 * r + 3 * c + 2 AS n_keys, 256 * (5 * r + 3 * c + 2) AS n_bytes, r + c <= 1000 AND 5 * r + 3 * c + 2 <= 5000 AND 256 * (5 * r + 3 * c + 2) <= 2097152 AS inline FROM n",
    "block_union": _SETS + "SELECT * FROM x UNION SELECT * FROM y UNION SELECT * FROM z",
    "block_intersect": _SETS + "SELECT * FROM x WHERE uid IN (SELECT uid FROM y) AND uid IN (SELECT uid FROM z)",
    "block_difference": _SETS + "SELECT * FROM x WHERE uid NOT IN (SELECT uid FROM y) AND uid NOT IN (SELECT uid FROM z)",
    "block_sorted_page": "SELECT p_partkey AS uid, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 30 OFFSET 5",
    "block_terms": "SELECT p_partkey AS uid FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['red', 'ring']) AND (p_type = 'ECONOMY' OR p_size >= 30) UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size <= 30",
    "block_siblings": "SELECT CAST(n_nationkey AS BIGINT) AS root_id, 'Region' AS node_type, CAST(n_regionkey AS BIGINT) AS node_id, 'IN_REGION' AS via FROM nation UNION ALL SELECT CAST(s_nationkey AS BIGINT), 'Supplier', s_suppkey, 'IN_NATION' FROM supplier WHERE s_acctbal < 0",
    "block_nested": "WITH p AS (SELECT c_custkey, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal >= 9900 AND o_totalprice > 100000 AND l_quantity > 30) SELECT 'root' AS what, c_custkey AS id, count(*) AS n FROM p GROUP BY c_custkey UNION ALL SELECT DISTINCT 'part', l_partkey, 1 FROM p",
    "block_cascade": "SELECT c_custkey AS root_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50)",
    "block_top_facets": "SELECT l_orderkey AS root_id, l_partkey AS node_id, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 450000 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) <= 2",
    "block_recurse": "SELECT CAST(n_regionkey AS BIGINT) AS root_id, 'Nation' AS node_type, 'IN_REGION|IN_NATION*1' AS via, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'Customer', 'IN_REGION|IN_NATION*2', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'Supplier', 'IN_REGION|IN_NATION*2', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    "block_point": "SELECT CAST(n_nationkey AS BIGINT) AS root_id, s_suppkey AS node_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey = 7",
    "block_groups": "SELECT c_mktsegment, count(c_custkey) AS n, max(c_nationkey) AS most FROM customer WHERE c_acctbal <= 5000 GROUP BY c_mktsegment",
    "validated": "WITH b AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1) SELECT p_partkey, 'here' AS p_origin, concat_ws(',', 'required:p_weight', CASE WHEN p_type IS NOT NULL THEN 'type:p_type' END, CASE WHEN p_size > 20 THEN 'extra:p_size' END, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN 'unique:p_brand' END) AS errors FROM part",
}
