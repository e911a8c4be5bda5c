"""Level-by-level traversal with a visited set, paths, bounds and continuation.

A hop is {labels, direction, edge_filter, node_filter, target, top, order, facets}.
Each level is one equi-join of the frontier with the edges; a node is visited
once, at its first arrival: the least depth, and of that the first path in the
order of its steps. Each level is written as a table, so plans don't grow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.cel import compile_cel
from graphloom.operators import edges as E
from graphloom.operators.tables import Tables

NODE = ["node_type", "node_id"]
MAX_DEPTH, MAX_RESULTS = 4, 10_000
Nodes = dict[str, tuple[DataFrame, str]]


def matching(nodes: Nodes, cel: str) -> DataFrame:
    """(node_type, node_id) of the nodes of all types that a filter keeps."""
    out = None
    for kind, (df, key) in nodes.items():
        part = df.where(compile_cel(cel, df.schema)).select(F.lit(kind).alias("node_type"), F.col(key).cast("bigint").alias("node_id"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Traversal:
    """``paths`` has the finished ones: (node_type, node_id, depth, path); the rest is what continuing needs."""

    paths: DataFrame
    frontier: DataFrame
    visited: DataFrame
    depth: int
    hops: list[dict]


def _step(hop: dict, edges: DataFrame, nodes: Nodes | None, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """The nodes that a hop arrives at first, with their paths."""
    if hop.get("node_filter") and not nodes:
        raise ValueError("a node filter needs the nodes")
    # the join below needs no filter by the frontier; ranking the edges of each source does
    near_only = frontier.select(*NODE) if hop.get("top") else None
    own = E.oriented(edges, hop.get("direction", "OUT"), hop.get("labels"), hop.get("edge_filter", ""), near_only, hop.get("target"))
    if hop.get("top"):
        own = E.top_edges(own, hop["top"], hop.get("order"))
    facets = [F.col(c).cast("string").alias(c) for c in hop.get("facets", [])]
    key = F.col("sort_key") if "sort_key" in own.columns else F.lit(None).cast("string")
    step = F.struct(F.col("label"), key.isNull().alias("unkeyed"), key.alias("sort_key"), F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), F.to_json(F.struct(*facets)).alias("facets") if facets else F.lit(None).cast("string").alias("facets"))
    near = own.select(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), F.struct(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id")).alias("to"), step.alias("step"))
    moved = frontier.join(near, NODE).select("to.*", F.concat("path", F.array("step")).alias("path"))
    if cel := hop.get("node_filter"):
        moved = moved.join(matching(nodes, cel), NODE, "left_semi")
    return moved.join(visited, NODE, "left_anti").groupBy(*NODE).agg(F.min("path").alias("path"))


def traverse(start: DataFrame, edges: DataFrame, hops: list[dict], nodes: Nodes | None = None, max_depth: int = MAX_DEPTH, max_results: int | None = None, tables: Tables | None = None, resume: Traversal | None = None) -> Traversal:
    """Paths from ``start`` (node_type, node_id) that complete all hops, or as many as ``max_depth`` lets.

    Dead ends are no results. ``resume`` goes on from where an earlier, shallower
    traversal with the same hops stopped. ``max_results`` takes the first paths in
    order. Paths are arrays of (label, unkeyed, sort_key, node_type, node_id,
    facets), the start's own entry first, without a label; edges without a sort
    key come behind those with one.
    """
    tables = tables or Tables(edges.sparkSession)
    none = F.lit(None).cast("string")
    if resume is None:
        kind = edges.schema["sort_key"].dataType if "sort_key" in edges.columns else "string"
        own = F.struct(none.alias("label"), F.lit(True).alias("unkeyed"), F.lit(None).cast(kind).alias("sort_key"), F.col("node_type"), F.col("node_id"), none.alias("facets"))
        front = tables.save(start.select(*NODE).distinct().select(*NODE, F.array(own).alias("path")))
        seen, depth = front.select(*NODE), 0
    else:
        front, seen, depth = resume.frontier, resume.visited, resume.depth
    while depth < min(len(hops), max_depth):
        front = tables.save(_step(hops[depth], edges, nodes, front, seen))
        seen = seen.unionByName(front.select(*NODE))
        depth += 1
    done = front.withColumn("depth", F.lit(depth)).select(*NODE, "depth", "path")
    done = done if max_results is None else done.orderBy("path").limit(max_results)
    return Traversal(done, front, seen, depth, hops)


def reach(start: DataFrame, edges: DataFrame, hop: dict, depth: int, nodes: Nodes | None = None, tables: Tables | None = None) -> DataFrame:
    """(node_type, node_id, depth) of all nodes within ``depth`` repetitions of a hop, start included at 0."""
    tables = tables or Tables(edges.sparkSession)
    hop = {k: v for k, v in hop.items() if k != "facets"}
    walk = traverse(start, edges, [hop] * depth, nodes, 0, tables=tables)
    out = walk.paths
    for level in range(1, depth + 1):
        walk = traverse(start, edges, [hop] * depth, nodes, level, tables=tables, resume=walk)
        if walk.frontier.isEmpty():
            break
        out = out.unionByName(walk.paths)
    return out.drop("path")


def nodes_of(walk: Traversal) -> DataFrame:
    return walk.paths.select(*NODE, "depth")


def stats(walk: Traversal) -> dict[str, int]:
    """Counts of visited nodes and results, each one action."""
    return {"visited": walk.visited.count(), "results": walk.paths.count(), "depth": walk.depth}
