"""Edges as (src_type, src_id, label, dst_type, dst_id, ...): expansion, adjacency, removal.

Optional columns: ``edge_id``, ``sort_key``, ``created_at`` and any properties.
Rows are edges of their own, so parallel edges stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.cel import compile_cel

ENDS = ["src_type", "src_id", "dst_type", "dst_id"]


def flipped(edges: DataFrame) -> DataFrame:
    swap = {"src_type": "dst_type", "src_id": "dst_id", "dst_type": "src_type", "dst_id": "src_id"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def _loop():
    return (F.col("src_type") == F.col("dst_type")) & (F.col("src_id") == F.col("dst_id"))


def mirrored(edges: DataFrame, labels: list[str]) -> DataFrame:
    """The edges, and those of bidirectional labels the other way round too (loops once)."""
    return edges.unionByName(flipped(edges.where(F.col("label").isin(labels) & ~_loop())))


def oriented(edges: DataFrame, direction: str = "OUT", labels: list[str] | None = None, cel: str = "", frontier: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """Edges that lead away from the frontier, ``src`` being the near end.

    BOTH has an edge once from either end (a loop once). ``labels``, the filter
    over edge properties and the frontier (node_type, node_id) are applied before
    anything is put together. ``target`` is the type that the far end must have.
    """
    own = edges.where(F.col("label").isin(labels)) if labels else edges
    own = own.where(compile_cel(cel, own.schema, undefined_false=True)) if cel else own
    out = own if direction != "IN" else flipped(own)
    if direction == "BOTH":
        out = own.unionByName(flipped(own.where(~_loop())))
    out = out.where(F.col("dst_type") == target) if target else out
    if frontier is not None:
        near = frontier.select(F.col("node_type").alias("__t"), F.col("node_id").alias("__i"))
        out = out.join(near, (F.col("src_type") == F.col("__t")) & (F.col("src_id") == F.col("__i")), "left_semi")
    return out


def in_order(edges: DataFrame) -> list:
    """By label, sort key (rows without one last), far end, edge id."""
    by = [F.col("label")]
    if "sort_key" in edges.columns:
        by.append(F.col("sort_key").asc_nulls_last())
    by += [F.col("dst_type"), F.col("dst_id")]
    return by + ([F.col("edge_id")] if "edge_id" in edges.columns else [])


def list_edges(edges: DataFrame, direction: str = "OUT", labels: list[str] | None = None, cel: str = "", frontier: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Adjacency; with a limit, a page by near end and then as in_order says."""
    out = oriented(edges, direction, labels, cel, frontier)
    return out if limit is None else out.orderBy("src_type", "src_id", *in_order(out)).offset(offset).limit(limit)


def top_edges(edges: DataFrame, k: int, order: list | None = None) -> DataFrame:
    """At most k edges of each source, in the given order, or as in_order says (a fan-out cap)."""
    w = Window.partitionBy("src_type", "src_id").orderBy(*(order or in_order(edges)))
    return edges.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def degree(nodes: DataFrame, key: str, edges: DataFrame, node_type: str | None = None) -> DataFrame:
    own = edges.where(F.col("src_type") == node_type) if node_type else edges
    counts = own.groupBy(F.col("src_id").alias("__src")).agg(F.count("*").alias("__n"))
    return nodes.join(counts, F.col(key) == F.col("__src"), "left").select(*nodes.columns, F.coalesce("__n", F.lit(0)).alias("degree"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Cascade of a delete: the edges of which neither end is in ``gone`` (node_type, node_id)."""
    at = lambda side: [F.col(f"{side}_type") == F.col("node_type"), F.col(f"{side}_id") == F.col("node_id")]
    return edges.join(gone, at("src"), "left_anti").join(gone, at("dst"), "left_anti")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_type, node_id, edge columns): each edge once for each of ``nodes`` that it ends at."""
    return oriented(edges, "BOTH", frontier=nodes).withColumnsRenamed({"src_type": "node_type", "src_id": "node_id", "dst_type": "other_type", "dst_id": "other_id"})


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is none of ``nodes`` (node_type, node_id)."""
    out, live = edges, nodes.select("node_type", "node_id").distinct()
    for side in ("src", "dst"):
        own = live.select(F.col("node_type").alias("__t"), F.col("node_id").alias("__i"), F.lit(True).alias(f"__{side}"))
        out = out.join(own, (F.col(f"{side}_type") == F.col("__t")) & (F.col(f"{side}_id") == F.col("__i")), "left").drop("__t", "__i")
    return out.where("__src IS NULL OR __dst IS NULL").select(*edges.columns)
