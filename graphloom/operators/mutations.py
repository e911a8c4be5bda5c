"""Writes: batches of requests become rows of the change log, or are rejected with a reason.

Nodes and edges are what ``changes.fold_nodes`` and ``changes.fold_edges`` make of
a log; a write is rows appended to it. Everything here is set-wise: a batch is
checked as a whole against the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators.aggregate import duplicate_values
from graphloom.operators.tables import Tables
from graphloom.sources.datasets import numbered
from graphloom.sources.schema import NodeType, validate
from graphloom.streaming import changes as C


@dataclass
class Written:
    """Rows for the log, and the requests that were turned down, with ``errors``."""

    log: DataFrame
    rejected: DataFrame


def _entries(rows: DataFrame, op: str, site: int | Column, ts: int, props: Column, **more: Column) -> DataFrame:
    empty = {"label": F.lit(None).cast("string"), "dst_type": F.lit(None).cast("string"), "dst_id": F.lit(None).cast("long")}
    cols = {"version": F.col("version"), "site": site if isinstance(site, Column) else F.lit(site), "ts": F.lit(ts).cast("long"), "op": F.lit(op), "type": F.col("type"), "id": F.col("id"), **empty, "props": props} | more
    return rows.select(*[c.alias(n) for n, c in cols.items()])


def _props(kind: NodeType, columns: list[str]) -> Column:
    named = [c for c in columns if c in kind.properties]
    return F.create_map(*[x for c in named for x in (F.lit(c), F.col(c).cast("string"))]).cast("map<string,string>")


def _taken(rows: DataFrame, kind: NodeType, existing: DataFrame, own: Column, changed: bool = False) -> DataFrame:
    """Adds unique:p to the errors of rows whose value another node has; with ``changed``, of those that change p,
    and then also where two rows change it to the same."""
    for n, p in kind.properties.items():
        if p.index != "unique" or n not in rows.columns:
            continue
        value = F.col(n).cast("string")
        rows = rows.withColumn("__u", F.when(F.map_contains_key("changed", n), value) if changed else value)
        there = existing.where(F.col("type") == kind.name).select(F.col("props")[n].alias("__v"), F.col("id").alias("__other")).where("__v IS NOT NULL")
        hit = rows.join(there, (F.col("__u") == F.col("__v")) & (own != F.col("__other")), "left_semi").select("id")
        if changed:
            hit = hit.unionByName(rows.join(duplicate_values(rows, ["__u"]).select("__u"), "__u", "left_semi").select("id"))
        rows = rows.join(hit.distinct().withColumn("__hit", F.lit(True)), "id", "left").withColumn("errors", F.when(F.col("__hit"), F.array_append("errors", F.lit(f"unique:{n}"))).otherwise(F.col("errors"))).drop("__hit", "__u")
    return rows


def create_nodes(requests: DataFrame, kind: NodeType, existing: DataFrame, by: list[str], version: int, site: int, ts: int) -> Written:
    """Nodes of a type, numbered behind the largest id there is, in the order of ``by``.

    Defaults, then the checks of ``validate``, then unique values against the nodes
    there are. What is rejected uses no id.
    """
    first = existing.where(F.col("type") == kind.name).agg(F.max("id")).first()[0]
    told = Tables(requests.sparkSession).save(validate(requests, kind).withColumn("id", F.monotonically_increasing_id()))
    checked = _taken(told, kind, existing, F.lit(-1))
    good = numbered(checked.where(F.size("errors") == 0).drop("id"), by, "__n")
    made = good.withColumn("id", F.col("__n") + (0 if first is None else first + 1)).withColumn("type", F.lit(kind.name)).withColumn("version", F.col("__n") + version)
    return Written(_entries(made, "NodeCreate", site, ts, _props(kind, made.columns)), checked.where(F.size("errors") > 0).drop("id"))


def update_nodes(requests: DataFrame, kind: NodeType, existing: DataFrame, version: int, site: int, ts: int) -> Written:
    """``requests``: (id, changed map<string,string>), one for each node; a null value takes a property away.

    The changes are merged over the node and the whole is checked, unique values
    where they change; a node that isn't there, or that another site owns, is
    rejected.
    """
    here = existing.where(F.col("type") == kind.name).select(F.col("id").alias("__id"), "site", F.col("props").alias("old"))
    both = requests.join(here, F.col("id") == F.col("__id"), "left")
    merged = F.map_filter(F.map_zip_with(F.coalesce("old", F.create_map().cast("map<string,string>")), "changed", lambda k, a, b: F.when(F.map_contains_key("changed", k), b).otherwise(a)), lambda k, v: v.isNotNull())
    flat = both.withColumn("__new", merged)
    wide = flat.select("id", "changed", "__id", "site", *[F.col("__new")[n].alias(n) for n in kind.properties])
    loose = replace(kind, properties={n: replace(p, index="none") for n, p in kind.properties.items()})
    checked = _taken(validate(wide, loose, ("id", "changed", "__id", "site")), kind, existing, F.col("id"), changed=True)
    reason = F.when(F.col("__id").isNull(), F.array(F.lit("missing"))).when(F.col("site") != site, F.array(F.lit("owner"))).otherwise(F.col("errors"))
    told = checked.withColumn("errors", reason)
    good = numbered(told.where(F.size("errors") == 0), ["id"], "__n").withColumn("version", F.col("__n") + version).withColumn("type", F.lit(kind.name))
    return Written(_entries(good, "NodeUpdate", site, ts, F.col("changed")), told.where(F.size("errors") > 0).select("id", "changed", "errors"))


def delete_nodes(requests: DataFrame, existing: DataFrame, edges: DataFrame, version: int, site: int, ts: int) -> Written:
    """``requests``: (type, id). Each node's deletion, and then those of the edges at it, once each."""
    gone = requests.select("type", "id").distinct()
    there = gone.join(existing.select("type", "id"), ["type", "id"], "left_semi")
    at = there.select(F.col("type").alias("node_type"), F.col("id").alias("node_id"))
    lost = E.oriented(edges, "OUT", frontier=at).unionByName(E.oriented(edges, "IN", frontier=at).transform(E.flipped)).select(*E.ENDS, "label").distinct()
    nodes = numbered(there, ["type", "id"], "__n").withColumn("version", F.col("__n") + version)
    none = F.create_map().cast("map<string,string>")
    first = version + there.count()
    cut = numbered(lost, ["src_type", "src_id", "label", "dst_type", "dst_id"], "__n").select((F.col("__n") + first).alias("version"), F.col("src_type").alias("type"), F.col("src_id").alias("id"), "label", "dst_type", "dst_id")
    log = _entries(nodes, "NodeDelete", site, ts, none).unionByName(_entries(cut, "EdgeDelete", site, ts, none, label=F.col("label"), dst_type=F.col("dst_type"), dst_id=F.col("dst_id")))
    return Written(log, gone.join(there, ["type", "id"], "left_anti").withColumn("errors", F.array(F.lit("missing"))))


def create_edges(requests: DataFrame, kinds: dict[str, NodeType], existing: DataFrame, version: int, site: int, ts: int) -> Written:
    """``requests``: (src_type, src_id, label, dst_type, dst_id, props). A repeated edge is one, the last by its props winning.

    The label must be declared for the type of the source (unless it takes
    undeclared ones) and lead to the type of the target; both ends must be there,
    and the source be owned by this site.
    """
    rules = [(t.name, n, e.target) for t in kinds.values() for n, e in t.edges.items()]
    spark = requests.sparkSession
    declared = F.broadcast(spark.createDataFrame(rules, "src_type string, label string, target string"))
    loose = [t.name for t in kinds.values() if t.undeclared_edges]
    live = existing.select("type", "id", "site")
    ends = requests.join(live.toDF("src_type", "src_id", "__site"), ["src_type", "src_id"], "left").join(live.toDF("dst_type", "dst_id", "__there"), ["dst_type", "dst_id"], "left")
    told = ends.join(declared, ["src_type", "label"], "left").withColumn("errors", F.array_compact(F.array(
        F.when(F.col("target").isNull() & ~F.col("src_type").isin(loose), F.lit("label")),
        F.when(F.col("target").isNotNull() & (F.col("target") != F.col("dst_type")) & (F.col("target") != "*"), F.lit("target")),
        F.when(F.col("__site").isNull(), F.lit("source")),
        F.when(F.col("__there").isNull(), F.lit("destination")),
        F.when(F.col("__site") != site, F.lit("owner")),
    )))
    edge = ["src_type", "src_id", "label", "dst_type", "dst_id"]
    key = [*edge, F.coalesce(F.col("props")["sort_key"], F.lit("")).alias("__sort")]
    good = told.where(F.size("errors") == 0).groupBy(*key).agg(F.max(F.to_json("props")).alias("__p")).withColumn("props", F.from_json("__p", "map<string,string>"))
    made = numbered(good, [*edge, "__sort"], "__n").select((F.col("__n") + version).alias("version"), F.col("src_type").alias("type"), F.col("src_id").alias("id"), "label", "dst_type", "dst_id", "props")
    log = _entries(made, "EdgeCreate", site, ts, F.col("props"), label=F.col("label"), dst_type=F.col("dst_type"), dst_id=F.col("dst_id"))
    return Written(log, told.where(F.size("errors") > 0).select(*edge, "props", "errors"))


def delete_edges(requests: DataFrame, edges: DataFrame, version: int, site: int, ts: int) -> Written:
    """``requests``: (src_type, src_id, label, dst_type, dst_id); one that isn't there is rejected."""
    edge = ["src_type", "src_id", "label", "dst_type", "dst_id"]
    wanted = requests.select(*edge).distinct()
    there = wanted.join(edges.select(*edge).distinct(), edge, "left_semi")
    made = numbered(there, edge, "__n").select((F.col("__n") + version).alias("version"), F.col("src_type").alias("type"), F.col("src_id").alias("id"), "label", "dst_type", "dst_id")
    none = F.create_map().cast("map<string,string>")
    return Written(_entries(made, "EdgeDelete", site, ts, none, label=F.col("label"), dst_type=F.col("dst_type"), dst_id=F.col("dst_id")), wanted.join(there, edge, "left_anti").withColumn("errors", F.array(F.lit("missing"))))


def transfer_ownership(requests: DataFrame, existing: DataFrame, version: int, actor: int, ts: int) -> Written:
    """``requests``: (type, id, to). Only the owner hands on; to itself is no change and no entry."""
    told = requests.join(existing.select("type", "id", F.col("site").alias("__site")), ["type", "id"], "left")
    told = told.withColumn("errors", F.when(F.col("__site").isNull(), F.array(F.lit("missing"))).when(F.col("__site") != actor, F.array(F.lit("owner"))).otherwise(F.array().cast("array<string>")))
    good = numbered(told.where((F.size("errors") == 0) & (F.col("to") != actor)), ["type", "id"], "__n").withColumn("version", F.col("__n") + version)
    return Written(_entries(good, "OwnershipTransfer", F.col("to").cast("int"), ts, F.create_map(F.lit("previous"), F.lit(str(actor)))), told.where(F.size("errors") > 0).select("type", "id", "to", "errors"))


STATE = "type string, id long, site int, created_at long, updated_at long, props map<string,string>, live boolean, applied int, ignored int"


def apply_replica(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(type, id, site, created_at, updated_at, props, live, applied, ignored): nodes after entries of several sites.

    Entries of a node apply in the order of versions. A create of a node that is
    there changes nothing. An update or delete of the owner applies, unless it saw
    another state (``old``, if the log has that column) and isn't newer; one of
    another site applies only if it is newer than the node, and an update then
    makes that site the owner. A transfer applies unless it names a ``previous``
    owner that the node hasn't and the node is newer. ``base`` is what is there
    before.

    The rule looks from one entry to the next, so the entries of each node are
    streamed in order through a task that holds one node at a time.
    """
    cols = ["version", "site", "ts", "op", "type", "id", "props"]
    own = log.where(F.col("op").isin(*C.NODE_OPS))
    own = own.select(*cols, F.col("old") if "old" in log.columns else F.lit(None).cast("map<string,string>").alias("old"))
    if base is not None:
        own = own.unionByName(base.select(F.lit(-1).cast("long").alias("version"), "site", F.col("updated_at").alias("ts"), F.lit("Base").alias("op"), "type", "id", "props", F.lit(None).cast("map<string,string>").alias("old")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.type, r.id) != now:
                    if state:
                        out.append((*now, *state))
                    now, state = (r.type, r.id), None
                props = dict(r.props) if r.props is not None else {}
                if state is None:
                    state = [None, None, None, {}, False, 0, 0]
                site, made, at, have, live, yes, no = state
                if r.op in ("NodeCreate", "Base"):
                    same = live and site == r.site and have == props
                    state = [site, made, at, have, live, yes + same, no + (not same)] if live else [r.site, r.ts, r.ts, {k: v for k, v in props.items() if v is not None}, True, yes + 1, no]
                    continue
                if r.op == "OwnershipTransfer":
                    stale = not live or (props.get("previous", str(site)) != str(site) and at > r.ts)
                    state = [site, made, at, have, live, yes, no + 1] if stale else [r.site, made, r.ts, have, live, yes + 1, no]
                    continue
                foreign = site != r.site
                stale = not live or (r.ts <= at and (foreign or (r.op == "NodeUpdate" and r.old is not None and dict(r.old) != have)))
                if stale:
                    state = [site, made, at, have, live, yes, no + 1]
                elif r.op == "NodeUpdate":
                    merged = {k: v for k, v in {**have, **props}.items() if v is not None}
                    state = [r.site if foreign else site, made, max(at, r.ts), merged, True, yes + 1, no]
                else:
                    state = [site, made, max(at, r.ts), {}, False, yes + 1, no]
            if out:
                yield _frame(out)
        if state:
            yield _frame([(*now, *state)])

    dealt = own.repartition("type", "id").sortWithinPartitions("type", "id", "version")
    return dealt.mapInPandas(run, STATE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in STATE.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("site", "created_at", "updated_at"):
        out[c] = out[c].astype("Int64")
    return out


def apply_replica_edges(log: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """The edge creations of a replica's log that apply: the first of each edge that isn't there, of a source that the
    entry's site owns or that is older than the entry. ``nodes``: (type, id, site, updated_at)."""
    edge = ["type", "id", "label", "dst_type", "dst_id"]
    new = log.where("op = 'EdgeCreate'").join(existing.toDF(*edge), edge, "left_anti")
    owner = nodes.select("type", "id", F.col("site").alias("__site"), F.col("updated_at").alias("__at"))
    fresh = new.join(owner, ["type", "id"]).where((F.col("site") == F.col("__site")) | (F.col("ts") > F.col("__at"))).drop("__site", "__at")
    w = Window.partitionBy(*edge).orderBy("version")
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
