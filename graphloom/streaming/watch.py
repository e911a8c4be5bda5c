"""Watches that follow a change log as a stream, and consumers of it.

A stream of the log (``changes.LOG``, read by ``readStream``) is filtered (point
and namespace watches) or kept in state by node (query watches: one boolean and
the current properties of each node). The batch form of a query watch is
``changes.transitions`` over folded states; both give the same events.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.functions.cel import compile_cel
from graphloom.streaming import changes as C


class OutOfRange(ValueError):
    code = "OUT_OF_RANGE"


def from_position(log: DataFrame, resume_after: int | None = None, oldest: int | None = None, start: str = "beginning") -> DataFrame:
    """The entries behind a position; one before the ``oldest`` that is retained can't be resumed.

    Without a position, from the ``beginning`` of what is retained, or, with
    ``start`` "now", nothing of what there is: the caller names its last version.
    """
    if resume_after is None:
        if start not in ("beginning", "now"):
            raise ValueError(f"no start {start!r}")
        return log if start == "beginning" else log.where(F.lit(False))
    if oldest is not None and resume_after < oldest - 1:
        raise OutOfRange(f"{resume_after} is older than what is retained, from {oldest} on")
    return log.where(F.col("version") > resume_after)


def watch_point(log: DataFrame, type_: str, id_: int, properties: list[str] | None = None, labels: list[str] | None = None, direction: str = "BOTH") -> DataFrame:
    """Operations on one node and the edges at it; updates only if they touch one of ``properties``."""
    near = (F.col("type") == type_) & (F.col("id") == id_)
    far = (F.col("dst_type") == type_) & (F.col("dst_id") == id_)
    node = near & F.col("op").isin(*C.NODE_OPS)
    if properties:
        node &= (F.col("op") != "NodeUpdate") | F.arrays_overlap(F.map_keys("props"), F.array(*map(F.lit, properties)))
    edge = {"OUT": near, "IN": far, "BOTH": near | far}[direction] & F.col("op").isin(*C.EDGE_OPS)
    if labels:
        edge &= F.col("label").isin(labels)
    return log.where(node | edge).withColumn("event", event_of())


def event_of() -> Column:
    """What an operation is to a watch that no filter over states decides."""
    return F.when(F.col("op").endswith("Create"), "ENTER").when(F.col("op").endswith("Delete"), "DELETE").when(F.col("op").isin("NodeUpdate", "OwnershipTransfer"), "UPDATE")


def watch_namespace(log: DataFrame) -> DataFrame:
    """All operations but registrations of schemas."""
    return log.withColumn("event", event_of()).where(F.col("event").isNotNull())


def states(log: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(version, op, type, id, fields...): each node operation with the node's properties after it, typed.

    Properties are carried from one operation to the next within a node's life,
    a null taking one away: what a query watch keeps in its state, as windows.
    """
    by = Window.partitionBy("type", "id").orderBy("version")
    own = log.where(F.col("op").isin(*C.NODE_OPS))
    own = own.withColumn("__life", F.sum(F.col("op").isin("NodeCreate", "NodeDelete").cast("int")).over(by))
    life = Window.partitionBy("type", "id", "__life").orderBy("version")
    cols = []
    for name, kind in fields.items():
        set_ = F.when(F.map_contains_key("props", name), F.struct(F.col("props")[name].alias("v")))
        cols.append(F.last(set_, ignorenulls=True).over(life)["v"].try_cast(kind).alias(name))
    return own.select("version", "op", "type", "id", *cols)


class _QueryWatch(StatefulProcessor):
    """One node's properties and whether it matched, from one operation to the next."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.props = handle.getValueState("props", T.StructType([T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("last", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        have, last = self.props.get() if self.props.exists() else ({}, -1)
        have = dict(have or {})
        batch = pd.concat(list(rows)).sort_values("version", kind="stable")
        out = []
        for r in batch.itertuples(index=False):
            if r.version <= last:  # an entry that was delivered again
                continue
            last = r.version
            if r.op in ("NodeCreate", "NodeDelete"):
                have = {}
            if r.op in ("NodeCreate", "NodeUpdate"):
                for k, v in dict(r.props or {}).items():
                    if k in self.names and v is not None:
                        have[k] = v
                    elif k in self.names:
                        have.pop(k, None)
            out.append((r.version, r.op, key[0], key[1], dict(have)))
        self.props.update((have, last))
        yield pd.DataFrame(out, columns=["version", "op", "type", "id", "props"])

    def close(self) -> None:
        pass


class _Tracked(StatefulProcessor):
    """Whether one node matched at its last operation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.was = handle.getValueState("was", "was boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        was = bool(self.was.get()[0]) if self.was.exists() else False
        out = []
        for r in pd.concat(list(rows)).sort_values("version", kind="stable").itertuples(index=False):
            event, now = None, was
            if r.op in ("NodeCreate", "NodeUpdate"):
                now = bool(r.matches)
                event = {(False, True): "ENTER", (True, True): "UPDATE", (True, False): "EXIT"}.get((was, now))
            elif was:
                event, now = ("DELETE", False) if r.op == "NodeDelete" else ("UPDATE", was)
            was = now
            if event:
                out.append((r.version, r.op, key[0], key[1], event))
        self.was.update((was,))
        yield pd.DataFrame(out, columns=["version", "op", "type", "id", "event"])

    def close(self) -> None:
        pass


def query_watch(log: DataFrame, type_: str, fields: dict[str, str], cel: str) -> DataFrame:
    """(version, op, type, id, event): the events of a query watch over a stream of the log.

    A first stateful step gives each operation the properties after it; the
    filter runs over them as a column; a second one compares with the state before.
    """
    own = log.where(F.col("op").isin(*C.NODE_OPS) & (F.col("type") == type_)).select("version", "op", "type", "id", "props")
    full = own.groupBy("type", "id").transformWithStateInPandas(_QueryWatch(list(fields)), "version long, op string, type string, id long, props map<string,string>", "Append", "None")
    typed = full.select("version", "op", "type", "id", *[F.col("props")[n].try_cast(k).alias(n) for n, k in fields.items()])
    tested = typed.select("version", "op", "type", "id", F.coalesce(compile_cel(cel, typed.schema), F.lit(False)).alias("matches"))
    return tested.groupBy("type", "id").transformWithStateInPandas(_Tracked(), "version long, op string, type string, id long, event string", "Append", "None")


def edge_events(log: DataFrame, matched: DataFrame) -> DataFrame:
    """Edge operations of which an end is one of the nodes matched now (type, id): the edge events of a query watch."""
    own = log.where(F.col("op").isin(*C.EDGE_OPS))
    ends = F.explode(F.array(F.struct("type", "id"), F.struct(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")))).alias("end")
    hit = own.select("version", ends).join(matched.select(F.struct("type", "id").alias("end")).distinct(), "end", "left_semi").select("version").distinct()
    return own.join(hit, "version", "left_semi").withColumn("event", event_of())


def snapshot_events(nodes: DataFrame, cel: str) -> DataFrame:
    """ENTER for each node that matches to begin with: (type, id, event, reason)."""
    return nodes.where(compile_cel(cel, nodes.schema)).select("type", "id", F.lit("ENTER").alias("event"), F.lit("initial_snapshot").alias("reason"))


def watch_id(*parts: str) -> str:
    """A name for a watch's checkpoint that its query decides."""
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()[:16]


def consume(log: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, ttl_seconds: float | None = None, name: str | None = None) -> StreamingQuery:
    """Hands each batch of a stream to ``handle`` at least once; its place is kept in the checkpoint.

    With ``ttl_seconds`` it ends at that time; without, once all there is has been read.
    """
    writer = log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    if ttl_seconds is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    query = writer.start()
    if not query.awaitTermination(ttl_seconds):
        query.stop()
    return query


class QuotaExceeded(RuntimeError):
    code = "RESOURCE_EXHAUSTED"


def active(spark: SparkSession) -> list[str]:
    return sorted(q.name or q.id for q in spark.streams.active)


def cancel(spark: SparkSession, name: str) -> bool:
    """Stops the stream of that name; false if there is none."""
    for q in spark.streams.active:
        if name in (q.name, q.id):
            q.stop()
            return True
    return False


def admit(spark: SparkSession, most: int) -> None:
    """Raises if ``most`` streams run already."""
    if len(spark.streams.active) >= most:
        raise QuotaExceeded(f"{most} watches run already")


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """A handler for ``consume`` that keeps the log of batches as a table; a batch delivered again replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle
