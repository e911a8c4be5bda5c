"""The change log against brute force; streams against their batch form."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import jobs as J
from graphloom.operators import mutations as M
from graphloom.sources.schema import Edge, NodeType, Property
from graphloom.streaming import changes as C
from graphloom.streaming import watch as V


def _random_log(seed, n=400, nodes=12):
    rnd = random.Random(seed)
    rows = []
    for v in range(n):
        op = rnd.choice(["NodeCreate", "NodeUpdate", "NodeUpdate", "NodeUpdate", "NodeDelete", "OwnershipTransfer", "EdgeCreate", "EdgeDelete"])
        i, j = rnd.randrange(nodes), rnd.randrange(nodes)
        edge = op.startswith("Edge")
        props = {k: rnd.choice([None, str(rnd.randrange(9))]) for k in rnd.sample("abc", rnd.randint(0, 3))} if op in ("NodeCreate", "NodeUpdate") else {}
        rows.append((v, rnd.randrange(3), v + rnd.randrange(-20, 20), op, "T", i, "e" if edge else None, "T" if edge else None, j if edge else None, props))
    return rows


@pytest.fixture(scope="module")
def logs(spark):
    rows = _random_log(1)
    return rows, spark.createDataFrame(rows, C.LOG)


def test_fold_nodes(spark, logs):
    rows, log = logs
    for cut in (None, 150):
        live = {}
        for v, site, _, op, _, i, *_, props in rows:
            if cut is not None and v > cut:
                break
            if op == "NodeCreate":
                live[i] = {}
            if op == "NodeDelete":
                live.pop(i, None)
            if op in ("NodeCreate", "NodeUpdate") and i in live:
                live[i] = {k: x for k, x in {**live[i], **props}.items() if x is not None}
        assert {r.id: r.props for r in C.fold_nodes(log, cut).collect()} == live


def test_read_state(spark, logs):
    _, log = logs
    old = C.fold_nodes(log, 150)
    assert C.read_state(log, old, 150, "eventual") is old and C.read_state(log, old, 150, "session", 100) is old
    assert C.read_state(log, old, 150, "session", 300).count() == C.read_state(log, old, 150).count() == C.fold_nodes(log).count()
    with pytest.raises(ValueError):
        C.read_state(log, old, 150, "maybe")


def test_fold_edges(spark, logs):
    rows, log = logs
    live = set()
    for _, _, _, op, _, i, _, _, j, _ in rows:
        if op == "EdgeCreate":
            live.add((i, j))
        if op == "EdgeDelete":
            live.discard((i, j))
        if op == "NodeDelete":
            live = {e for e in live if i not in e}
    assert {(r.src_id, r.dst_id) for r in C.fold_edges(log).collect()} == live and live


def _watch(rows, match):
    """(version, event), by going through the log."""
    have, was, out = {}, {}, []
    for v, _, _, op, _, i, *_, props in rows:
        if op in ("NodeCreate", "NodeDelete"):
            have[i] = {}
        if op in ("NodeCreate", "NodeUpdate"):
            have[i] = {k: x for k, x in {**have.get(i, {}), **props}.items() if x is not None}
            now = match(have[i])
            event = {(False, True): "ENTER", (True, True): "UPDATE", (True, False): "EXIT"}.get((was.get(i, False), now))
            was[i] = now
        elif op == "NodeDelete":
            event = "DELETE" if was.get(i) else None
            was[i] = False
        else:
            event = "UPDATE" if op == "OwnershipTransfer" and was.get(i) else None
        if event:
            out.append((v, event))
    return out


FIELDS, CEL = {"a": "bigint", "b": "bigint"}, "a >= 4 && b != null"


def test_query_watch_batch_and_stream(spark, logs, tmp_path):
    rows, log = logs
    want = _watch(rows, lambda p: int(p.get("a", 0)) >= 4 and "b" in p)
    batch = C.transitions(V.states(log, FIELDS), ["type", "id"], "version", CEL, "op")
    assert sorted((r.version, r.event) for r in batch.collect()) == want and len(want) > 20
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # three files, three batches
            part = log.where(F.col("version").between(k * 150, k * 150 + 149))
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            stream = spark.readStream.schema(C.LOG).parquet(f"{tmp_path}/log")
            V.consume(V.query_watch(stream, "T", FIELDS, CEL), V.merge_into(f"{tmp_path}/out"), f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.version, r.event) for r in got.collect()) == want


def test_consumer_delivers_all_once_more_or_less(spark, logs, tmp_path):
    """A consumer goes on where it stopped; what it keeps is the log."""
    _, log = logs
    log.where("version < 100").coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = lambda: spark.readStream.schema(C.LOG).parquet(f"{tmp_path}/log")
    V.consume(V.watch_namespace(stream()), V.merge_into(f"{tmp_path}/out"), f"{tmp_path}/at", name="copy")
    log.where("version >= 100").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    V.consume(V.watch_namespace(stream()), V.merge_into(f"{tmp_path}/out"), f"{tmp_path}/at")
    assert sorted(r.version for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(400))
    assert V.active(spark) == [] and not V.cancel(spark, "copy")
    V.admit(spark, 1)
    with pytest.raises(V.QuotaExceeded):
        V.admit(spark, 0)


def test_watch_parts(spark, logs):
    rows, log = logs
    point = {r.version for r in V.watch_point(log, "T", 3, ["a"], ["e"], "OUT").collect()}
    want = {r[0] for r in rows if r[5] == 3 and (r[3] in ("NodeCreate", "NodeDelete", "OwnershipTransfer", "EdgeCreate", "EdgeDelete") or (r[3] == "NodeUpdate" and "a" in r[9]))}
    assert point == want
    matched = spark.createDataFrame([("T", 1), ("T", 2)], "type string, id long")
    assert {r.version for r in V.edge_events(log, matched).collect()} == {r[0] for r in rows if r[3].startswith("Edge") and (r[5] in (1, 2) or r[8] in (1, 2))}
    assert V.from_position(log, 200).count() == 199 and V.from_position(log, None, start="now").count() == 0
    with pytest.raises(V.OutOfRange):
        V.from_position(log, 5, oldest=50)
    assert V.watch_id("a", "b") != V.watch_id("ab")


def _replica(rows):
    """The conflict rule, entry by entry."""
    out = {}
    for v, site, ts, op, _, i, *_, props in rows:
        if op.startswith("Edge"):
            continue
        s = out.setdefault(i, {"site": None, "at": None, "props": {}, "live": False, "yes": 0, "no": 0})
        if op == "NodeCreate":
            if s["live"]:
                s["yes" if s["site"] == site and s["props"] == props else "no"] += 1
            else:
                s |= {"site": site, "at": ts, "props": {k: x for k, x in props.items() if x is not None}, "live": True, "yes": s["yes"] + 1}
            continue
        if op == "OwnershipTransfer" and s["live"]:
            s |= {"site": site, "at": ts, "yes": s["yes"] + 1}
            continue
        foreign = s["site"] != site
        if not s["live"] or (foreign and ts <= s["at"]):
            s["no"] += 1
            continue
        s["yes"] += 1
        s["at"] = max(s["at"], ts)
        if op == "NodeUpdate":
            s["props"] = {k: x for k, x in {**s["props"], **props}.items() if x is not None}
        if op == "NodeDelete":
            s |= {"live": False, "props": {}}
        elif foreign:
            s["site"] = site
    return {i: tuple(s.values()) for i, s in out.items()}


def test_apply_replica(spark, logs):
    for seed in (1, 2, 3):
        rows = _random_log(seed)
        got = {r.id: (r.site, r.updated_at, r.props, r.live, r.applied, r.ignored) for r in M.apply_replica(spark.createDataFrame(rows, C.LOG)).collect()}
        assert got == _replica(rows)


def test_replica_edges(spark):
    edge = lambda v, site, ts, i, j: (v, site, ts, "EdgeCreate", "T", i, "e", "T", j, {})
    log = spark.createDataFrame([edge(0, 1, 5, 1, 2), edge(1, 1, 6, 1, 2), edge(2, 2, 5, 1, 3), edge(3, 2, 50, 1, 4), edge(4, 1, 5, 1, 5)], C.LOG)
    nodes = spark.createDataFrame([("T", 1, 1, 10)], "type string, id long, site int, updated_at long")
    there = spark.createDataFrame([("T", 1, "e", "T", 5)], "a string, b long, c string, d string, e long")
    assert sorted(r.version for r in M.apply_replica_edges(log, nodes, there).collect()) == [0, 3]


def test_writes_round_trip(spark):
    """What is created, updated and deleted through the log is what folding it gives."""
    kind = NodeType("P", {"name": Property("string", True, "unique"), "age": Property("int", default=1)}, {"knows": Edge("P")})
    none = spark.createDataFrame([], "type string, id long, site int, updated_at long, props map<string,string>")
    made = M.create_nodes(spark.createDataFrame([("a", 5), ("b", None), (None, 3), ("c", 7), ("c", 8)], "name string, age long"), kind, none, ["name"], 0, 1, 10)
    assert [r.props for r in made.log.orderBy("version").collect()] == [{"name": "a", "age": "5"}, {"name": "b", "age": "1"}]
    assert sorted((r.name or "", r.errors) for r in made.rejected.collect()) == [("", ["required:name"]), ("c", ["unique:name"]), ("c", ["unique:name"])]
    state = C.fold_nodes(made.log)
    change = M.update_nodes(spark.createDataFrame([(0, {"name": "b"}), (1, {"age": "9"}), (7, {"age": "1"})], "id long, changed map<string,string>"), kind, state, 10, 1, 20)
    assert [(r.id, r.props) for r in change.log.collect()] == [(1, {"age": "9"})]
    assert sorted((r.id, r.errors) for r in change.rejected.collect()) == [(0, ["unique:name"]), (7, ["missing"])]
    asked = spark.createDataFrame([("P", 0, "knows", "P", 1, {}), ("P", 0, "likes", "P", 1, {}), ("P", 0, "knows", "P", 8, {})], "src_type string, src_id long, label string, dst_type string, dst_id long, props map<string,string>")
    tied = M.create_edges(asked, {"P": kind}, state, 20, 1, 30)
    assert sorted((r.dst_id, r.label, r.errors) for r in tied.rejected.collect()) == [(1, "likes", ["label"]), (8, "knows", ["destination"])]
    log = made.log.unionByName(change.log).unionByName(tied.log)
    assert C.fold_edges(log).count() == 1
    cut = M.delete_edges(asked, C.fold_edges(log), 30, 1, 40)
    assert cut.log.count() == 1 and cut.rejected.count() == 2
    gone = M.delete_nodes(spark.createDataFrame([("P", 1), ("P", 5)], "type string, id long"), C.fold_nodes(log), C.fold_edges(log), 30, 1, 40)
    assert [r.op for r in gone.log.orderBy("version").collect()] == ["NodeDelete", "EdgeDelete"] and gone.rejected.count() == 1
    after = log.unionByName(gone.log)
    assert C.fold_edges(after).count() == 0 and [(r.id, r.props) for r in C.fold_nodes(after).collect()] == [(0, {"name": "a", "age": "5"})]
    moved = M.transfer_ownership(spark.createDataFrame([("P", 0, 2), ("P", 1, 2)], "type string, id long, to int"), C.fold_nodes(after), 40, 1, 50)
    assert [(r.id, r.site) for r in moved.log.collect()] == [(0, 2)]
    assert C.fold_nodes(after.unionByName(moved.log)).first().site == 2


def test_jobs(spark):
    nodes = spark.createDataFrame([("A", 1, {"x": "1", "y": "2"}), ("B", 2, {"x": "3"})], "node_type string, node_id long, props map<string,string>")
    edges = spark.createDataFrame([("A", 1, "e", "B", 2), ("A", 1, "e", "A", 1), ("B", 2, "e", "B", 9)], "src_type string, src_id long, label string, dst_type string, dst_id long")
    assert [r.props for r in J.strip_property(nodes, "x").orderBy("node_id").collect()] == [{"y": "2"}, {}]
    assert J.strip_property(nodes, "props").columns == ["node_type", "node_id"]
    left = J.drop_type(nodes, edges, "B")
    assert left[0].count() == 1 and left[1].count() == 1
    assert J.clean_orphans(edges, nodes.select("node_type", "node_id")).count() == 2
    left = J.delete_cascade(nodes, edges, nodes.where("node_id = 1").select("node_type", "node_id"))
    assert left[0].count() == 1 and [(r.src_id, r.dst_id) for r in left[1].collect()] == [(2, 9)]
    index = J.backfill_index(nodes.select("node_id", F.col("props")["x"].alias("x")), "node_id", ["x"])
    assert index.count() == 2 and J.drop_index(index, ["x"]).count() == 0
    log = spark.range(10).select(F.col("id").alias("version"), F.col("id").alias("ts"))
    readers = spark.createDataFrame([("a", 5), ("b", 8)], "consumer string, position long")
    assert J.retain_log(log, "version", "ts", 7, readers).count() == 5 and J.retain_log(log, "version", "ts", 7, readers.limit(0)).count() == 10
    assert J.sweep(log, "ts", 4).count() == 6
