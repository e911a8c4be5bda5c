"""Data sets of JSON lines: types, nodes with aliases, edges between aliases."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.edges import mirrored
from graphloom.operators.tables import Tables
from graphloom.sources.schema import Catalog, KINDS, NodeType


class LoadError(ValueError):
    pass


@dataclass
class DataSet:
    catalog: Catalog
    nodes: dict[str, tuple[DataFrame, str]]
    edges: DataFrame


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``by``, without gathering them in one task.

    Partitions are sorted by range, written, counted, and numbered from their own offsets.
    """
    spark = df.sparkSession
    parts = Tables(spark).save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = sorted((r["__p"], r["n"], r["low"]) for r in parts.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("low")).collect())
    rows, total = [], 0
    for p, n, low in counts:
        rows.append((p, total - low))
        total += n
    shift = spark.createDataFrame(rows, "__p int, __shift long")
    return parts.join(F.broadcast(shift), "__p").withColumn(name, F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load(spark: SparkSession, folder: str, site: int = 1) -> DataSet:
    """``schemas.json``, ``nodes.jsonl`` and ``edges.jsonl`` of a folder, by any path that Spark reads.

    Nodes get ids in the order of their aliases within their type; edges are
    resolved by alias (an unknown one is an error), and those of bidirectional
    labels stand the other way round too.
    """
    catalog = Catalog()
    text = "\n".join(r[0] for r in spark.read.text(f"{folder}/schemas.json", wholetext=True).collect())
    for spec in json.loads(text):
        catalog.register(spec)
    raw = _read(spark, f"{folder}/nodes.jsonl", "id string, entity_type string, properties string").withColumnRenamed("id", "alias")
    known = list(catalog.versions)
    if bad := raw.where(~F.col("entity_type").isin(known)).select("entity_type").limit(1).collect():
        raise LoadError(f"no type {bad[0][0]!r}")
    ids, nodes = None, {}
    for kind in map(catalog.get, known):
        own = numbered(raw.where(F.col("entity_type") == kind.name), ["alias"], "node_id")
        nodes[kind.name] = (own.select("node_id", F.lit(site).alias("site"), "alias", F.from_json("properties", _struct(kind)).alias("p")).select("node_id", "site", "alias", "p.*"), "node_id")
        part = own.select("alias", F.lit(kind.name).alias("t"), "node_id")
        ids = part if ids is None else ids.unionByName(part)
    edges = _read(spark, f"{folder}/edges.jsonl", "source string, label string, target string, properties string")
    at = lambda side, end: ids.select(F.col("alias").alias(side), F.col("t").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id"))
    joined = edges.join(at("source", "src"), "source", "left").join(at("target", "dst"), "target", "left")
    if lost := joined.where("src_id IS NULL OR dst_id IS NULL").select("source", "target").limit(1).collect():
        raise LoadError(f"an edge has an unknown end: {lost[0][0]!r} to {lost[0][1]!r}")
    own = joined.select("src_type", "src_id", "label", "dst_type", "dst_id", F.xxhash64("source", "label", "target", "properties").alias("edge_id"), "properties")
    both = [n for t in known for n in catalog.get(t).bidirectional()]
    return DataSet(catalog, nodes, mirrored(own, both) if both else own)


def _struct(kind: NodeType) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(KINDS[p.kind])) for n, p in kind.properties.items()])
