"""Queries of named blocks: a root, directives, nested edge selections, variables.

A block is plain data; ``Graph.run`` turns each into a DataFrame. Blocks may use
each other's rows by name in any order (a cycle is an error). A block's variable
holds its whole rows; the fields of a block are chosen on output only.

    Graph(nodes, edges).run([
        Block("rich", type_("Customer"), filter="acctbal > 9000"),
        Block("places", uid_of("rich"), expand=[Expand(["IN_NATION"], expand=[Expand(["IN_REGION"])])]),
    ])
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.cel import compile_cel
from graphloom.functions.fields import Field, with_params
from graphloom.operators import aggregate as A
from graphloom.operators import edges as E
from graphloom.operators import nodes as N
from graphloom.operators.traversal import NODE, Traversal, matching, traverse


class QueryError(ValueError):
    code = "ERR_VALIDATION_QUERY"


@dataclass(frozen=True)
class Root:
    """What a block begins with: nodes of a type that a filter keeps, or the rows of other blocks."""

    type: str | None = None
    cel: str = ""
    id: object = None
    blocks: tuple[str, ...] = ()
    how: str = "union"


def uid(type_: str, id_: object) -> Root:
    """One node."""
    return Root(type_, id=id_)


def uid_of(*blocks: str, how: str = "union") -> Root:
    """The rows of a block, or the union, intersect or difference of several."""
    if how not in ("union", "intersect", "difference"):
        raise QueryError(f"no set operation {how!r}")
    return Root(blocks=blocks, how=how)


def type_(name: str) -> Root:
    return Root(name)


def eq(type_: str, name: str, value: object) -> Root:
    return Root(type_, Field(name) == value)


def ge(type_: str, name: str, value: object) -> Root:
    return Root(type_, Field(name) >= value)


def le(type_: str, name: str, value: object) -> Root:
    return Root(type_, Field(name) <= value)


def gt(type_: str, name: str, value: object) -> Root:
    return Root(type_, Field(name) > value)


def lt(type_: str, name: str, value: object) -> Root:
    return Root(type_, Field(name) < value)


def between(type_: str, name: str, low: object, high: object) -> Root:
    """Both ends included."""
    return Root(type_, Field(name).between(low, high))


def has(type_: str, name: str) -> Root:
    return Root(type_, Field(name).has())


def allofterms(type_: str, name: str, terms: str) -> Root:
    return Root(type_, Field(name).allofterms(terms))


@dataclass
class Expand:
    """An edge selection; nested ones are further hops, those side by side are siblings.

    ``edge`` filters edge properties, ``filter`` the nodes arrived at (their
    properties), ``target`` their type. ``sort`` [(field, descending)] and
    ``limit`` choose edges of each source. ``facets`` are edge properties to
    return. ``name`` makes what is arrived at a variable.
    """

    labels: list[str]
    direction: str = "OUT"
    edge: str = ""
    filter: str = ""
    target: str | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    facets: list[str] = field(default_factory=list)
    name: str | None = None
    expand: list[Expand] = field(default_factory=list)


@dataclass
class Block:
    """``select`` are the fields of the output (``uid``: the id). With ``expand``, rows are (root, arrived at) pairs.

    ``cascade`` leaves out roots that have nothing in one of their selections (at
    any depth); else they stay, with nulls. ``recurse`` repeats a single selection
    up to that depth. ``group_by`` with ``aggregates`` returns groups instead.
    """

    name: str
    root: Root
    filter: str = ""
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    select: list[str] | None = None
    expand: list[Expand] = field(default_factory=list)
    cascade: bool = False
    recurse: int | None = None
    group_by: list[str] | None = None
    aggregates: dict[str, tuple[str, str]] = field(default_factory=dict)


def _names(block: Block) -> list[str]:
    def below(xs: list[Expand]) -> list[str]:
        return [n for x in xs for n in ([x.name] if x.name else []) + below(x.expand)]

    return [block.name, *below(block.expand)]


def in_order(blocks: list[Block]) -> list[Block]:
    """The blocks, each behind those it uses; else as they were."""
    maker = {}
    for b in blocks:
        for n in _names(b):
            if n in maker:
                raise QueryError(f"{n!r} is defined twice")
            maker[n] = b.name
    todo, done, out = list(blocks), set(), []
    for b in blocks:
        if unknown := [n for n in b.root.blocks if n not in maker]:
            raise QueryError(f"{b.name!r} uses unknown {', '.join(unknown)}")
    while todo:
        ready = next((b for b in todo if all(maker[n] in done for n in b.root.blocks)), None)
        if ready is None:
            raise QueryError(f"blocks use each other in a circle: {', '.join(b.name for b in todo)}")
        todo.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def watched(block: Block, params: dict | None = None) -> tuple[str, str]:
    """(type, filter) of a watch for what a block finds: its root's filter and its own together."""
    if block.root.blocks or block.root.type is None:
        raise QueryError("a watch needs a root of a type")
    if block.root.id is not None:
        raise QueryError("watch one node as a point")
    parts = [with_params(c, params or {}) for c in (block.root.cel, block.filter) if c]
    return block.root.type, " && ".join(f"({c})" for c in parts)


class Graph:
    """Nodes by type (frame, id column) and one frame of edges."""

    def __init__(self, nodes: dict[str, tuple[DataFrame, str]], edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def find(self, type_: str, cel: str = "", fields: list[str] | None = None, limit: int | None = N.DEFAULT_LIMIT, offset: int = 0, after: tuple | None = None) -> DataFrame:
        """Nodes of a type in id order, the id with them."""
        df, key = self._typed(type_)
        return N.find(df, cel, fields, [key], limit, offset, after, (key,) if fields is not None else ())

    def traverse(self, start: DataFrame, hops: list[dict], **bounds) -> Traversal:
        return traverse(start, self.edges, hops, self.nodes, **bounds)

    def degree(self, type_: str, direction: str = "OUT", labels: list[str] | None = None) -> DataFrame:
        """(key, degree) of the nodes of a type."""
        df, key = self._typed(type_)
        return E.degree(df.select(key), key, E.oriented(self.edges, direction, labels), type_)

    def _typed(self, kind: str) -> tuple[DataFrame, str]:
        if kind not in self.nodes:
            raise QueryError(f"no type {kind!r}")
        return self.nodes[kind]

    def _rooted(self, root: Root, vars_: dict[str, DataFrame], params: dict) -> DataFrame:
        if root.blocks:
            sets = [vars_[n] for n in root.blocks]
            return sets[0] if len(sets) == 1 else {"union": N.union, "intersect": N.intersect, "difference": N.difference}[root.how](sets, NODE)
        df, key = self._typed(root.type)
        own = df.select(F.lit(root.type).alias("node_type"), F.col(key).cast("bigint").alias("node_id"), *[c for c in df.columns if c not in NODE])
        if root.id is not None:
            own = own.where(F.col("node_id") == F.lit(root.id))
        return own.where(compile_cel(with_params(root.cel, params), own.schema)) if root.cel else own

    def _step(self, x: Expand, front: DataFrame, params: dict) -> DataFrame:
        """(root_type, root_id, node_type, node_id, facets...) one hop on from (root_type, root_id, node_type, node_id)."""
        near_only = front.select(*NODE).distinct() if x.limit is not None else None
        own = E.oriented(self.edges, x.direction, x.labels, with_params(x.edge, params), near_only, x.target)
        if x.limit is not None:
            by = [F.col(c).desc() if down else F.col(c).asc() for c, down in x.sort]
            own = E.top_edges(own, x.limit, by + E.in_order(own))
        near = own.select(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), F.struct("label", F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), *x.facets).alias("to"))
        moved = front.select("root_type", "root_id", *NODE).join(near, NODE).select("root_type", "root_id", "to.*")
        if x.filter:
            moved = moved.join(matching(self.nodes, with_params(x.filter, params)), NODE, "left_semi")
        return moved

    def _expanded(self, xs: list[Expand], front: DataFrame, vars_: dict, params: dict, via: str = "") -> tuple[list[DataFrame], list[DataFrame]]:
        """Rows of the selections and what is below them; for each leaf, the roots that reach it."""
        rows, leaves = [], []
        for x in xs:
            moved = self._step(x, front, params)
            at = f"{via}{'|'.join(x.labels)}"
            if x.name:
                vars_[x.name] = moved.select(*NODE).distinct()
            rows.append(moved.withColumn("via", F.lit(at)))
            more, ends = self._expanded(x.expand, moved, vars_, params, at + ">")
            rows += more
            leaves += ends if x.expand else [moved]
        return rows, leaves

    def run(self, blocks: list[Block], params: dict | None = None) -> dict[str, DataFrame]:
        """name -> rows, for each block (and each named selection)."""
        params, vars_, out = params or {}, {}, {}
        for b in in_order(blocks):
            rows = self._rooted(b.root, vars_, params)
            rows = rows.where(compile_cel(with_params(b.filter, params), rows.schema)) if b.filter else rows
            if b.sort or b.limit is not None or b.offset:
                by = [F.col(c).desc() if down else F.col(c).asc() for c, down in b.sort]
                rows = rows.orderBy(*by, *NODE).offset(b.offset)
                rows = rows if b.limit is None else rows.limit(b.limit)
            if not b.expand:
                vars_[b.name] = rows
                out[b.name] = self._output(b, rows)
                continue
            roots = rows.select(*NODE, F.col("node_type").alias("root_type"), F.col("node_id").alias("root_id"))
            if b.recurse:
                if len(b.expand) != 1 or b.expand[0].expand:
                    raise QueryError("only a single selection can be repeated")
                steps = [roots]
                for _ in range(b.recurse):
                    # a node counts once for each root, where it is reached first; the root itself not at all
                    seen = reduce(lambda p, q: p.unionByName(q), [s.select("root_type", "root_id", *NODE) for s in steps])
                    moved = self._step(b.expand[0], steps[-1], params).dropDuplicates(["root_type", "root_id", *NODE])
                    steps.append(moved.join(seen, ["root_type", "root_id", *NODE], "left_anti"))
                found = [s.withColumn("via", F.lit(f"{'|'.join(b.expand[0].labels)}*{k}")) for k, s in enumerate(steps[1:], 1)]
                leaves = [steps[1]]
            else:
                found, leaves = self._expanded(b.expand, roots, vars_, params)
            all_ = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), found)
            if b.cascade:
                for leaf in leaves:
                    rows = rows.join(leaf.select(F.col("root_type").alias("node_type"), F.col("root_id").alias("node_id")), NODE, "left_semi")
            vars_[b.name] = rows
            keys = rows.select(F.col("node_type").alias("root_type"), F.col("node_id").alias("root_id"))
            out[b.name] = keys.join(all_, ["root_type", "root_id"], "inner" if b.cascade else "left")
        return out | {n: v for n, v in vars_.items() if n not in out}

    @staticmethod
    def _output(b: Block, rows: DataFrame) -> DataFrame:
        if b.group_by is not None:
            return A.group_by(rows, b.group_by, b.aggregates)
        if b.aggregates:
            return A.group_by(rows, [], b.aggregates)
        return N.select_fields(rows, b.select, "node_id") if b.select else rows

    def explain(self, blocks: list[Block], params: dict | None = None) -> str:
        """The order of the blocks, and Spark's plan of each."""
        ran = self.run(blocks, params)
        order = in_order(blocks)
        return "\n".join(f"== {b.name} ==\n{ran[b.name]._jdf.queryExecution().explainString(ran[b.name]._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}" for b in order)
