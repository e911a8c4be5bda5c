"""Change log: reads, folds to current state, retention, and enter/update/exit transitions.

A log of operations has the columns of ``LOG``: one row for each operation, in the
order of ``version``. ``props`` holds what an operation sets; a null value takes a
property away. Edge operations bear the near end in ``type`` and ``id`` and the
far end in ``dst_type`` and ``dst_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.cel import compile_cel

NODE_OPS = ("NodeCreate", "NodeUpdate", "NodeDelete", "OwnershipTransfer")
EDGE_OPS = ("EdgeCreate", "EdgeDelete")
OPS = (*NODE_OPS, *EDGE_OPS, "SchemaRegister")
LOG = "version long, site int, ts long, op string, type string, id long, label string, dst_type string, dst_id long, props map<string,string>"


def read_after(log: DataFrame, version: str, after: int, limit: int | None = None, site: tuple[str, object] | None = None) -> DataFrame:
    """Entries strictly behind a version, in order if there is a limit; of one site (column, value) if named, before the limit."""
    out = log.where(F.col(version) > after)
    out = out if site is None else out.where(F.col(site[0]) == F.lit(site[1]))
    return out if limit is None else out.orderBy(version).limit(limit)


def fold(log: DataFrame, keys: list[str], version: str, as_of: int | None = None) -> DataFrame:
    """The last row of each key, up to a version; a partial aggregation, no window."""
    own = log if as_of is None else log.where(F.col(version) <= as_of)
    rest = [c for c in log.columns if c not in keys]
    return own.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__row")).select(*keys, "__row.*")


def fold_nodes(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """(type, id, site, updated_at, props): the nodes that a log leaves.

    An update is merged over what was there, property by property; a null takes
    one away. A delete ends a node, and a later create begins it anew. The site is
    that of the create or of the last transfer of ownership.
    """
    own = log.where(F.col("op").isin(*NODE_OPS))
    own = own if as_of is None else own.where(F.col("version") <= as_of)
    key = ["type", "id"]
    begin = F.max(F.when(F.col("op").isin("NodeCreate", "NodeDelete"), F.struct("version", "op")))
    owner = F.max_by("site", F.when(F.col("op").isin("NodeCreate", "OwnershipTransfer"), F.col("version")))
    lives = own.groupBy(*key).agg(begin.alias("begin"), owner.alias("owner"), F.max("ts").alias("updated_at")).where("begin.op = 'NodeCreate'").select(*key, F.col("begin.version").alias("since"), F.col("owner").alias("site"), "updated_at")
    set_ = own.where(F.col("op").isin("NodeCreate", "NodeUpdate")).select(*key, "version", F.explode("props").alias("name", "value"))
    last = set_.join(lives.select(*key, "since"), key).where("version >= since").groupBy(*key, "name").agg(F.max_by("value", "version").alias("value")).where("value IS NOT NULL")
    props = last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    return lives.drop("since").join(props, key, "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def fold_edges(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The edges that a log leaves: the last create of each (ends, label, sort key), unless deleted since, alone or with an end."""
    own = log if as_of is None else log.where(F.col("version") <= as_of)
    edge = ["src_type", "src_id", "label", "dst_type", "dst_id"]
    ops = own.where(F.col("op").isin(*EDGE_OPS)).select(F.col("type").alias("src_type"), F.col("id").alias("src_id"), "label", "dst_type", "dst_id", "version", "op", "props", F.coalesce(F.col("props")["sort_key"], F.lit("")).alias("sort_key"))
    made = ops.where("op = 'EdgeCreate'").groupBy(*edge, "sort_key").agg(F.max_by(F.struct("version", "props"), "version").alias("m")).select(*edge, "sort_key", "m.*")
    gone = ops.where("op = 'EdgeDelete'").groupBy(*edge).agg(F.max("version").alias("gone"))
    dead = own.where("op = 'NodeDelete'").groupBy("type", "id").agg(F.max("version").alias("dead"))
    out = made.join(gone, edge, "left").where("gone IS NULL OR gone < version").drop("gone")
    for side in ("src", "dst"):
        at = dead.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"), "dead")
        out = out.join(at, [f"{side}_type", f"{side}_id"], "left").where("dead IS NULL OR dead < version").drop("dead")
    return out.select(*edge, "sort_key", "props")


def retain(log: DataFrame, version: str, ts: str, older_than, checkpoint: int) -> DataFrame:
    """Drops entries that are both older than the cut and below every consumer's checkpoint."""
    return log.where(~((F.col(ts) < older_than) & (F.col(version) < checkpoint)))


def transitions(log: DataFrame, keys: list[str], version: str, cel: str, op: str | None = None) -> DataFrame:
    """The events that a watch of a filter sees: ENTER, UPDATE, EXIT or DELETE.

    Each row is the state of its key after a change. With ``op``, the column of
    operations: a delete is an event only of a key that matched before it, and a
    transfer of ownership an update of such a key; a schema or edge operation is none.
    """
    match = F.coalesce(compile_cel(cel, log.schema), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(version)
    seen = log
    if op is None:
        seen = log.withColumn("__now", match)
    else:
        state = F.when(F.col(op).isin("NodeCreate", "NodeUpdate"), match).when(F.col(op) == "NodeDelete", F.lit(False))
        seen = log.where(F.col(op).isin(*NODE_OPS)).withColumn("__now", state)
    before = F.last("__now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("__was", F.coalesce(before, F.lit(False)))
    event = F.when(F.col("__now") & ~F.col("__was"), "ENTER").when(F.col("__now"), "UPDATE").when(~F.col("__now") & F.col("__was"), "EXIT")
    if op is not None:
        event = F.when((F.col(op) == "NodeDelete") & F.col("__was"), "DELETE").when((F.col(op) == "OwnershipTransfer") & F.col("__was"), "UPDATE").otherwise(event)
    return seen.withColumn("event", event).where(F.col("event").isNotNull()).drop("__now", "__was")


def read_state(log: DataFrame, snapshot: DataFrame, snapshot_version: int, consistency: str = "strong", required: int | None = None) -> DataFrame:
    """Nodes as of the end of the log (``strong``), of any snapshot (``eventual``), or of one that has ``required`` (``session``).

    The snapshot is an earlier result of fold_nodes; a session that it is too old for reads the log.
    """
    if consistency not in ("strong", "session", "eventual"):
        raise ValueError(f"no consistency {consistency!r}")
    if consistency == "eventual" or (consistency == "session" and required is not None and snapshot_version >= required):
        return snapshot
    return fold_nodes(log)
