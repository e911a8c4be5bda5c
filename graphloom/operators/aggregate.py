"""Aggregates over nodes and edges: groups, value variables, term statistics, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators.nodes import postings

_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _column(kind: str, field: str, name: str) -> Column:
    if kind not in _AGGREGATES:
        raise ValueError(f"no aggregate {kind!r}")
    return _AGGREGATES[kind](field).alias(name)


def group_by(nodes: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Groups by the keys (none: one row); aggregates are name -> (count, sum, avg, min or max; field). Nulls don't count."""
    own = [_column(kind, field, name) for name, (kind, field) in aggregates.items()]
    return nodes.groupBy(*keys).agg(*own) if keys else nodes.agg(*own)


def value_of(nodes: DataFrame, kind: str, field: str) -> object:
    """A value variable: one aggregate, as a value to build filters and columns from."""
    return nodes.agg(_column(kind, field, "v")).first()[0]


def document_frequency(nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, value, n): how many nodes have each value."""
    return postings(nodes, key, fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def duplicate_values(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Values (and how often) that break a unique constraint on the fields; nulls break none."""
    present = nodes.dropna(subset=fields)
    return present.groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")


def percentiles(rows: DataFrame, keys: list[str], field: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles by linear interpolation, as columns p50, p95, ..."""
    every = F.percentile(field, F.array(*map(F.lit, shares))).alias("p")
    return rows.groupBy(*keys).agg(every).select(*keys, *[F.col("p")[i].alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


#: Keys that go with a node, an edge and a bidirectional edge, and the bytes taken for each; limits of an inline delete.
NODE_KEYS, EDGE_KEYS, BOTH_KEYS, KEY_BYTES = 2, 3, 5, 256
MOST_EDGES, MOST_KEYS, MOST_BYTES = 1000, 5000, 2 << 20


def delete_scope(nodes: DataFrame, edges: DataFrame, bidirectional: list[str]) -> DataFrame:
    """(node_type, node_id, n_edges, n_keys, n_bytes, inline): what deleting each node takes, and whether it can be done at once."""
    keys = F.when(F.col("label").isin(bidirectional), BOTH_KEYS).otherwise(EDGE_KEYS) if bidirectional else F.lit(EDGE_KEYS)
    own = E.incident(edges, nodes).groupBy("node_type", "node_id").agg(F.count("*").alias("n_edges"), F.sum(keys).alias("k"))
    all_ = nodes.select("node_type", "node_id").join(own, ["node_type", "node_id"], "left")
    n = F.coalesce("n_edges", F.lit(0)).cast("bigint")
    k = (F.coalesce("k", F.lit(0)) + NODE_KEYS).cast("bigint")
    return all_.select("node_type", "node_id", n.alias("n_edges"), k.alias("n_keys"), (k * KEY_BYTES).alias("n_bytes"), ((n <= MOST_EDGES) & (k <= MOST_KEYS) & (k * KEY_BYTES <= MOST_BYTES)).alias("inline"))
