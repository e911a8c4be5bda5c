"""Maintenance over whole tables: each job is one pass that returns the table as it is after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators.nodes import postings
from graphloom.streaming.changes import retain


def strip_property(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes without a property: its column, or its key in ``props``."""
    if name in nodes.columns:
        return nodes.drop(name)
    return nodes.withColumn("props", F.map_filter("props", lambda k, _: k != name))


def backfill_index(nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The entries (field, value, key) of newly indexed properties."""
    return postings(nodes, key, fields)


def drop_index(index: DataFrame, fields: list[str]) -> DataFrame:
    return index.where(~F.col("field").isin(fields))


def drop_type(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (with a column ``node_type``) and edges after a type is dropped: none of it, and no edge at it."""
    return nodes.where(F.col("node_type") != name), edges.where((F.col("src_type") != name) & (F.col("dst_type") != name))


def clean_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node_type, node_id)."""
    for side in ("src", "dst"):
        edges = edges.join(nodes, [F.col(f"{side}_type") == F.col("node_type"), F.col(f"{side}_id") == F.col("node_id")], "left_semi")
    return edges


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the nodes of ``gone`` (node_type, node_id) are deleted."""
    return nodes.join(gone, ["node_type", "node_id"], "left_anti"), E.without_nodes(edges, gone)


def retain_log(log: DataFrame, version: str, ts: str, older_than, checkpoints: DataFrame) -> DataFrame:
    """The log without what is old and what every consumer (consumer, position) has read; without consumers nothing goes."""
    least = checkpoints.agg(F.min("position")).first()[0]
    return log if least is None else retain(log, version, ts, older_than, least)


def sweep(rows: DataFrame, ts: str, older_than) -> DataFrame:
    """Audit records or saved watch states, without what is older."""
    return rows.where(F.col(ts) >= older_than)
