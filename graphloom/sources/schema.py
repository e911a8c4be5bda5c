"""Node types: properties, edges, versions, and checks of nodes against them.

A type is read from compact JSON: ``{"name", "properties": {p: {type, required,
index, default}}, "edges": {label: {target, direction, sort_key, properties}},
"extras"}``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.aggregate import duplicate_values

#: Property types, their Spark types and the index that each has if none is named.
KINDS = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp", "bytes": "binary"}
DEFAULT_INDEX = {"int": "range", "float": "range", "timestamp": "range", "bool": "equality", "string": "none", "bytes": "none"}
#: The share of rows that a lookup by an index is taken to find.
SELECTIVITY = {"unique": 0.01, "equality": 0.10, "range": 0.50, "none": 1.0}


class SchemaError(ValueError):
    code = "ERR_VALIDATION_SCHEMA"


@dataclass(frozen=True)
class Property:
    kind: str
    required: bool = False
    index: str | None = None
    default: object = None

    def index_kind(self) -> str:
        return self.index or DEFAULT_INDEX[self.kind]


@dataclass(frozen=True)
class Edge:
    target: str
    direction: str = "outgoing"
    sort_key: str | None = None
    properties: tuple[str, ...] = ()
    ownership: str = "source"


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: dict[str, Property] = field(default_factory=dict)
    edges: dict[str, Edge] = field(default_factory=dict)
    extras: str = "allow"
    undeclared_edges: bool = False
    version: int = 0

    @staticmethod
    def parse(spec: dict | str) -> NodeType:
        """From a dict or its JSON; what doesn't hold together raises SchemaError."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        props = {n: Property(p["type"], bool(p.get("required")), p.get("index"), p.get("default")) for n, p in spec.get("properties", {}).items()}
        edges = {n: Edge(e["target"], e.get("direction", "outgoing"), e.get("sort_key"), tuple(e.get("properties", {})), e.get("ownership", "source")) for n, e in spec.get("edges", {}).items()}
        out = NodeType(spec.get("name", ""), props, edges, spec.get("extras", "allow"), bool(spec.get("allow_undeclared_edges")))
        out.check()
        return out

    def check(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.name):
            raise SchemaError(f"no type name: {self.name!r}")
        if self.extras not in ("reject", "allow", "warn"):
            raise SchemaError(f"no extras policy: {self.extras!r}")
        for n, p in self.properties.items():
            if p.kind not in KINDS:
                raise SchemaError(f"{self.name}.{n} has no type {p.kind!r}")
            if p.index not in (None, *SELECTIVITY):
                raise SchemaError(f"{self.name}.{n} has no index {p.index!r}")
        for n, e in self.edges.items():
            if e.sort_key and e.sort_key not in e.properties:
                raise SchemaError(f"{self.name}.{n} sorts by {e.sort_key!r}, which it hasn't")
            if e.direction not in ("outgoing", "bidirectional"):
                raise SchemaError(f"{self.name}.{n} has no direction {e.direction!r}")
            if e.ownership == "independent":
                raise SchemaError(f"{self.name}.{n} can't be owned independently")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, T._parse_datatype_string(KINDS[p.kind])) for n, p in self.properties.items()])

    def bidirectional(self) -> list[str]:
        return [n for n, e in self.edges.items() if e.direction == "bidirectional"]


class Catalog:
    """Types by name, each with its earlier versions."""

    def __init__(self) -> None:
        self.versions: dict[str, list[NodeType]] = {}

    def register(self, spec: NodeType | dict | str) -> NodeType:
        """The next version of a type; whatever it changes."""
        own = spec if isinstance(spec, NodeType) else NodeType.parse(spec)
        own.check()
        had = self.versions.setdefault(own.name, [])
        new = NodeType(own.name, own.properties, own.edges, own.extras, own.undeclared_edges, len(had) + 1)
        had.append(new)
        return new

    def apply_replica(self, spec: NodeType | dict | str, version: int) -> bool:
        """A version from another site: the next one is taken, one already here ignored, a later one an error."""
        own = spec if isinstance(spec, NodeType) else NodeType.parse(spec)
        now = len(self.versions.get(own.name, []))
        if version > now + 1:
            raise SchemaError(f"{own.name} is at {now}, not at {version - 1}")
        if version <= now:
            return False
        self.register(own)
        return True

    def get(self, name: str, version: int | None = None) -> NodeType:
        had = self.versions.get(name)
        if not had or not 1 <= (version or len(had)) <= len(had):
            raise SchemaError(f"no type {name!r}" + (f" of version {version}" if version else ""))
        return had[(version or len(had)) - 1]

    def newly_indexed(self, name: str) -> list[str]:
        """Properties that the latest version indexes and the one before doesn't."""
        had = self.versions[name]
        old = had[-2].properties if len(had) > 1 else {}
        return [n for n, p in had[-1].properties.items() if p.index_kind() != "none" and (n not in old or old[n].index_kind() == "none")]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.version, n, p.kind, p.required, p.index_kind()) for ts in self.versions.values() for t in ts for n, p in t.properties.items()]
        return spark.createDataFrame(rows, "name string, version int, property string, kind string, required boolean, index string")


def with_defaults(nodes: DataFrame, kind: NodeType) -> DataFrame:
    """Missing columns added; the default stands where a value is missing."""
    cols = [F.col(c) for c in nodes.columns if c not in kind.properties]
    for n, p in kind.properties.items():
        own = F.col(n) if n in nodes.columns else F.lit(None).cast(KINDS[p.kind])
        cols.append(F.coalesce(own, F.lit(p.default).cast(KINDS[p.kind])).alias(n) if p.default is not None else own.alias(n))
    return nodes.select(*cols)


def _fits(c: str, have: T.DataType, kind: str) -> Column:
    """Whether a column's values are of a property's type: by its own type, or, of text, value by value."""
    same = {"string": T.StringType, "int": T.IntegralType, "float": T.FractionalType, "bool": T.BooleanType, "timestamp": T.DatetimeType, "bytes": T.BinaryType}
    if isinstance(have, T.StringType) and kind not in ("string", "bytes"):
        return F.col(c).isNull() | F.col(c).try_cast(KINDS[kind]).isNotNull()
    return F.lit(isinstance(have, same[kind])) | F.col(c).isNull()


def validate(nodes: DataFrame, kind: NodeType, system: tuple[str, ...] = ()) -> DataFrame:
    """The nodes with defaults, and ``errors``: array of what is wrong with each, in the order the checks are made.

    required (missing or null), type, extras (``system`` columns are none), and
    values of unique properties that stand in two nodes.
    """
    out = with_defaults(nodes, kind)
    checks = [F.when(F.col(n).isNull(), F.lit(f"required:{n}")) for n, p in kind.properties.items() if p.required]
    checks += [F.when(~_fits(n, out.schema[n].dataType, p.kind), F.lit(f"type:{n}")) for n, p in kind.properties.items()]
    if kind.extras == "reject":
        checks += [F.when(F.col(c).isNotNull(), F.lit(f"extra:{c}")) for c in out.columns if c not in kind.properties and c not in system]
    out = out.withColumn("errors", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
    for n, p in kind.properties.items():
        if p.index == "unique":
            twice = duplicate_values(out.select(n), [n]).select(F.col(n).alias("__twice"))
            out = out.join(twice, F.col(n) == F.col("__twice"), "left")
            out = out.withColumn("errors", F.when(F.col("__twice").isNotNull(), F.array_append("errors", F.lit(f"unique:{n}"))).otherwise(F.col("errors"))).drop("__twice")
    return out
