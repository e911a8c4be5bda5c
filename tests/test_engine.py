"""CEL edge by edge, datasets, schema, paging, traversal, blocks: what the queries over tables don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.cel import CelSyntaxError, CelTypeError, compile_cel
from graphloom.functions.fields import Fields, with_params
from graphloom.operators import access as X
from graphloom.operators import edges as E
from graphloom.operators import limits
from graphloom.operators import nodes as N
from graphloom.operators import traversal as W
from graphloom.plans import blocks as B
from graphloom.sources import datasets, output, schema as S

PEOPLE = [("p_alice", "Alice", 34, "San Francisco"), ("p_bob", "Bob", 29, "San Francisco"), ("p_carol", "Carol", 31, "New York"), ("p_dan", "Dan", 27, "Austin"), ("p_eve", "Eve", 36, "Seattle")]
FOLLOWS = [("p_alice", "follows", "p_bob"), ("p_alice", "follows", "p_carol"), ("p_bob", "follows", "p_dan"), ("p_carol", "follows", "p_eve"), ("p_bob", "works_with", "p_carol"), ("p_alice", "works_with", "p_eve")]
TYPES = [{"name": "Person", "properties": {"name": {"type": "string", "required": True}, "age": {"type": "int", "index": "range"}, "city": {"type": "string", "index": "equality"}}, "edges": {"follows": {"target": "Person", "direction": "outgoing"}, "works_with": {"target": "Person", "direction": "bidirectional"}}}]


def _write(folder, edges=FOLLOWS):
    (folder / "schemas.json").write_text(json.dumps(TYPES, indent=1))
    (folder / "nodes.jsonl").write_text("".join(json.dumps({"id": i, "entity_type": "Person", "properties": {"name": n, "age": a, "city": c}}) + "\n" for i, n, a, c in PEOPLE))
    (folder / "edges.jsonl").write_text("".join(json.dumps({"source": a, "label": n, "target": b, "properties": {}}) + "\n" for a, n, b in edges))
    return str(folder)


@pytest.fixture(scope="module")
def social(spark, tmp_path_factory):
    return datasets.load(spark, _write(tmp_path_factory.mktemp("social")))


@pytest.mark.parametrize(
    ("cel", "want"),
    [
        ("", "ABCDE"),
        ("age >= 30", "ACE"),
        ('city == "San Francisco" && age < 30', "B"),
        ('city == "Austin" || age >= 36', "DE"),
        ('city == "San"', ""),
        ('city > "Al"', "ABCDE"),
        ("!(city > 5)", ""),
        ("!(nope > 5)", ""),
        ("nope == null && city != null", "ABCDE"),
        ("age + 9223372036854775807 > 0", ""),
        ("!(age + 9223372036854775807 > 0)", ""),
        ("-9223372036854775808 < age", "ABCDE"),
        ("9007199254740993 / 1 == 9007199254740993 && age == 27", "D"),
        ("age / 0 == 1 || age == 27", "D"),
        ("-7 / 2 == -3 && -7 % 2 == -1 && age == 27", "D"),
        ("1.0 / 0.0 > 5.0 && age == 27", "D"),
        ("age * 2.0 == 54.0", "D"),
        ("name.matches('[')", ""),
        ("!name.matches('[')", ""),
        ("name.matches('^A')", "A"),
        ("size(age) == 2", ""),
        ("size(name) == 3", "BDE"),
        ("age in [27, 29] && name in ['Bob']", "B"),
        ("(age > 30 ? name : city) == 'Austin'", "D"),
        ("int('27') == age || double(age) > 35.5 || string(age) == '29'", "BDE"),
        ("has(nope) || name.endsWith('e') && name.contains('li')", "A"),
        ("name + '!' == 'Dan!'", "D"),
        ("allofterms(city, 'YORK new')", "C"),
        ("true && age == 27 || false", "D"),
    ],
)
def test_cel(spark, cel, want):
    people = spark.createDataFrame([(n, a, c) for _, n, a, c in PEOPLE], "name string, age long, city string")
    assert "".join(sorted(r.name[0] for r in people.where(compile_cel(cel, people.schema)).collect())) == want


@pytest.mark.parametrize("cel", ["age >=", "age ^ 2", "nofunc(age)", "9223372036854775808 > age", "(age > 1", "age > 1 age"])
def test_cel_syntax(spark, cel):
    with pytest.raises(CelSyntaxError):
        compile_cel(cel, spark.range(1).select(F.col("id").alias("age")).schema)


@pytest.mark.parametrize("cel", ["age + 1", "name", "age && true", "name * 2 == 4", "age > 1 ? 'a' : 2"])
def test_cel_types(spark, cel):
    with pytest.raises(CelTypeError):
        compile_cel(cel, spark.createDataFrame([], "age long, name string").schema)


def test_undefined_name_in_edge_filter(spark):
    """null to a node filter, an error to an edge filter."""
    df = spark.range(3)
    assert df.where(compile_cel("nope == null", df.schema)).count() == 3
    assert df.where(compile_cel("nope == null", df.schema, undefined_false=True)).count() == 0
    assert df.where(compile_cel("nope == null || id == 1", df.schema, undefined_false=True)).count() == 1


def test_fields_and_params():
    assert (Fields.name == "O'Hara\n") & (Fields.age > 3) == "(name == 'O\\'Hara\\n') && (age > 3)"
    assert with_params("a == $x && b == '$x' && c == $y && d == $xx", {"x": "it's", "y": None}) == "a == 'it\\'s' && b == '$x' && c == null && d == $xx"
    with pytest.raises(ValueError):
        getattr(Fields, "a b") > 1  # noqa: B015


def test_load(spark, social):
    people = social.nodes["Person"][0]
    assert [(r.node_id, r.alias, r.age) for r in people.orderBy("node_id").collect()] == [(i, p[0], p[2]) for i, p in enumerate(PEOPLE)]
    assert social.edges.count() == 8 and social.catalog.get("Person").version == 1


def test_load_unknown_alias(spark, tmp_path):
    with pytest.raises(datasets.LoadError):
        datasets.load(spark, _write(tmp_path, [*FOLLOWS, ("p_alice", "follows", "p_zoe")]))


def _names(social, rows):
    who = social.nodes["Person"][0].select("node_id", "name")
    return "".join(sorted(r.name[0] for r in rows.select("node_id").join(who, "node_id").collect()))


def _at(social, alias):
    return social.nodes["Person"][0].where(F.col("alias") == alias).select(F.lit("Person").alias("node_type"), "node_id")


@pytest.mark.parametrize(
    ("start", "hops", "want"),
    [
        ("p_alice", [{"labels": ["follows"]}], "BC"),
        ("p_alice", [{"labels": ["follows"]}] * 2, "DE"),
        ("p_bob", [{"labels": ["follows"], "direction": "IN"}], "A"),
        ("p_eve", [{"labels": ["works_with"]}], "A"),
        ("p_alice", [{"labels": ["follows"]}, {"labels": ["follows"], "node_filter": "age >= 30"}], "E"),
        ("p_dan", [{"labels": ["follows"]}], ""),
        ("p_alice", [{"direction": "BOTH"}] * 2, "D"),
    ],
)
def test_traverse(spark, social, start, hops, want):
    assert _names(social, W.traverse(_at(social, start), social.edges, hops, social.nodes).paths) == want


def test_traverse_bounds(spark, social):
    """Depth, number of results, going on, and a filter without nodes."""
    hops = [{"labels": ["follows"]}] * 2
    start = _at(social, "p_alice")
    assert _names(social, W.traverse(start, social.edges, hops, max_depth=1).paths) == "BC"
    assert _names(social, W.traverse(start, social.edges, hops, max_results=1).paths) == "D"
    first = W.traverse(start, social.edges, hops, max_depth=1)
    assert _names(social, W.traverse(start, social.edges, hops, resume=first).paths) == "DE"
    assert W.stats(first) == {"visited": 3, "results": 2, "depth": 1}
    with pytest.raises(ValueError):
        W.traverse(start, social.edges, [{"node_filter": "age > 100"}])
    got = {(r.node_id, r.depth) for r in W.reach(start, social.edges, {"labels": ["follows"]}, 9).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)}


def test_first_arrival_by_sort_key(spark):
    """Of paths of one length the first counts: by label, sort key (as a number, those without one last), far end."""
    rows = [("N", 0, "e", "N", 1, 10), ("N", 0, "e", "N", 2, 9), ("N", 0, "e", "N", 3, None), ("N", 1, "e", "N", 7, 1), ("N", 2, "e", "N", 7, 1), ("N", 3, "e", "N", 7, 1), ("N", 1, "e", "N", 8, 1), ("N", 3, "e", "N", 8, 1), ("N", 3, "d", "N", 9, None)]
    edges = spark.createDataFrame(rows, "src_type string, src_id long, label string, dst_type string, dst_id long, sort_key int")
    start = spark.createDataFrame([("N", 0)], "node_type string, node_id long")
    got = W.traverse(start, edges, [{}, {}]).paths
    assert {r.node_id: r.path[1].node_id for r in got.collect()} == {7: 2, 8: 1, 9: 3}
    assert [r.node_id for r in W.traverse(start, edges, [{}], max_results=2).paths.orderBy("path").collect()] == [2, 1]
    assert {r.node_id for r in W.traverse(start, edges, [{"top": 1}, {"facets": ["sort_key"]}]).paths.collect()} == {7}


def test_loops_and_parallel_edges(spark):
    rows = [("N", 1, "e", "N", 2, 10), ("N", 1, "e", "N", 2, 11), ("N", 1, "e", "N", 1, 12)]
    edges = spark.createDataFrame(rows, "src_type string, src_id long, label string, dst_type string, dst_id long, edge_id long")
    assert sorted((r.src_id, r.edge_id) for r in E.oriented(edges, "BOTH").collect()) == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11)]
    assert E.mirrored(edges, ["e"]).count() == 5
    one = spark.createDataFrame([("N", 2)], "node_type string, node_id long")
    assert [r.edge_id for r in E.without_nodes(edges, one).collect()] == [12]
    assert sorted(r.edge_id for r in E.orphans(edges, one).collect()) == [10, 11, 12]


def test_pages(spark):
    """Pages by either cursor put together are the table; the key reaches the scan."""
    nodes = spark.range(25).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"))
    got, cursor, n = [], None, 0
    while True:
        page = N.page(nodes, ["a", "b"], "b != 7", size=6, cursor=cursor)
        got += [tuple(r) for r in page.rows.collect()]
        n += 1
        if not page.has_more:
            break
        cursor = page.cursor
    assert got == sorted((i % 4, i) for i in range(25) if i != 7) and n == 4 and page.cursor is None
    assert N.page(nodes, ["b"], size=5, cursor=N.offset_cursor(3)).rows.orderBy("b").first().b == 3
    assert N.find(nodes, "b > 20").count() == 4
    with pytest.warns(UserWarning):
        N.find(nodes, limit=20_000)
    with pytest.raises(ValueError):
        N.read_cursor(b"xx")
    with pytest.raises(N.UnknownField):
        N.select_fields(nodes, ["a", "nope"])


def test_lookup_keeps_order(spark):
    ids = spark.createDataFrame([(0, 7), (1, 99), (2, 3), (3, 7)], "pos int, id long")
    got = N.lookup(spark.range(10).select(F.col("id").alias("k")), ids, "k", ordered=True)
    assert [(r.pos, r.k) for r in got.collect()] == [(0, 7), (1, None), (2, 3), (3, 7)]


def test_union_takes_the_earliest(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in N.union([a, b], ["k"]).collect()) == [(1, "a"), (2, "b")]
    assert sorted(tuple(r) for r in N.union([b, a], ["k"]).collect()) == [(1, "b"), (2, "b")]


def test_blocks(spark, social):
    g = B.Graph(social.nodes, social.edges)
    ran = g.run([B.Block("old", B.uid_of("friends"), select=["uid"]), B.Block("start", B.uid("Person", 0), expand=[B.Expand(["follows"], name="friends", expand=[B.Expand(["follows"])])])])
    assert sorted(r.uid for r in ran["old"].collect()) == [1, 2]
    assert sorted((r.via, r.node_id) for r in ran["start"].collect()) == [("follows", 1), ("follows", 2), ("follows>follows", 3), ("follows>follows", 4)]
    assert "== old ==" in g.explain([B.Block("old", B.has("Person", "age"))])


def test_graph(spark, social):
    g = B.Graph(social.nodes, social.edges)
    assert [r.name for r in g.find("Person", "age > 28", ["name"], limit=2, after=(0,)).collect()] == ["Bob", "Carol"]
    assert g.find("Person").count() == 5
    assert _names(social, g.traverse(_at(social, "p_alice"), [{"labels": ["follows"]}]).paths) == "BC"
    assert {r.node_id: r.degree for r in g.degree("Person", "OUT", ["follows"]).collect()} == {0: 2, 1: 1, 2: 1, 3: 0, 4: 0}
    assert B.watched(B.Block("b", B.ge("Person", "age", 30), filter="city == $c"), {"c": "x"}) == ("Person", "(age >= 30) && (city == 'x')")
    assert B.watched(B.Block("b", B.allofterms("Person", "city", "new"))) == ("Person", "(allofterms(city, 'new'))")
    for bad in (B.uid("Person", 1), B.uid_of("x")):
        with pytest.raises(B.QueryError):
            B.watched(B.Block("b", bad))


@pytest.mark.parametrize(
    "blocks",
    [
        [B.Block("a", B.uid_of("b")), B.Block("b", B.uid_of("a"))],
        [B.Block("a", B.uid_of("nope"))],
        [B.Block("a", B.type_("Person")), B.Block("a", B.type_("Person"))],
        [B.Block("a", B.type_("Nobody"))],
        [B.Block("a", B.type_("Person"), recurse=2, expand=[B.Expand(["x"]), B.Expand(["y"])])],
    ],
)
def test_block_errors(spark, social, blocks):
    with pytest.raises(B.QueryError):
        B.Graph(social.nodes, social.edges).run(blocks)


@pytest.mark.parametrize(
    "spec",
    [
        {"name": "a-b"},
        {"name": ""},
        {"name": "A", "extras": "maybe"},
        {"name": "A", "properties": {"x": {"type": "list"}}},
        {"name": "A", "properties": {"x": {"type": "int", "index": "hash"}}},
        {"name": "A", "edges": {"e": {"target": "B", "sort_key": "at"}}},
        {"name": "A", "edges": {"e": {"target": "B", "ownership": "independent"}}},
    ],
)
def test_schema_errors(spec):
    with pytest.raises(S.SchemaError):
        S.NodeType.parse(spec)


def test_catalog(spark):
    c = S.Catalog()
    assert c.register({"name": "A", "properties": {"x": {"type": "int"}, "s": {"type": "string"}}}).version == 1
    assert c.get("A").properties["x"].index_kind() == "range" and c.get("A").properties["s"].index_kind() == "none"
    assert c.register({"name": "A", "properties": {"s": {"type": "string", "index": "equality"}}}).version == 2
    assert c.newly_indexed("A") == ["s"] and list(c.get("A", 1).properties) == ["x", "s"]
    assert not c.apply_replica({"name": "A"}, 2) and c.apply_replica({"name": "A"}, 3) and c.get("A").version == 3
    with pytest.raises(S.SchemaError):
        c.apply_replica({"name": "A"}, 9)
    with pytest.raises(S.SchemaError):
        c.get("B")
    assert c.table(spark).count() == 3


def test_output(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", [1, 2], bytearray(b"x")), (2, None, None, None)], "k int, s string, xs array<int>, b binary")
    output.save(df, f"{tmp_path}/j")
    output.save(df, f"{tmp_path}/c", "csv")
    assert sorted(r.k for r in spark.read.json(f"{tmp_path}/j").collect()) == [1, 2]
    assert [tuple(r) for r in spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/c").orderBy("k").collect()] == [("1", 'a,"b"', "[1,2]", "eA=="), ("2", None, None, None)]
    assert output.table(df.orderBy("k").select("k", "xs")).splitlines() == ["k | xs", "--+------", "1 | [1,2]", "2 |"]
    with pytest.raises(ValueError):
        output.save(df, f"{tmp_path}/x", "xml")


def test_limits(spark):
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(limits.TimedOut):
        limits.within(spark, 1.5, lambda: spark.range(8).select(slow("id")).collect())
    assert limits.within(spark, 60, lambda: spark.range(8).count()) == 8
    guard = limits.Guard(spark.range(100), most_rows=99)
    assert guard.rows.collect() and not guard.check(degrade=True)
    with pytest.raises(limits.TooLarge):
        guard.check()
    guard = limits.Guard(spark.range(100), most_rows=100)
    assert guard.rows.collect() and guard.check()


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.k == r.n for r in datasets.numbered(df, ["k"], "n").collect())
    assert datasets.numbered(df.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize(("pattern", "path", "want"), [("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/+", "a/b/d", True), ("a/+", "a", False), ("a.b/*", "axb/c", False), ("a/*", "a/", False), ("*", "x", True)])
def test_paths(spark, pattern, path, want):
    import re

    assert bool(re.match(X.path_pattern(pattern), path)) == want
    assert spark.createDataFrame([(pattern, path)], "p string, q string").select(X.path_matches(F.col("p"), F.col("q"))).first()[0] == want


def test_roles_and_leases(spark):
    rows = [(["admin"], "d", "n", "x"), (["namespace-admin:d:n"], "d", "n", "x"), (["namespace-admin:d:m"], "d", "n", "x"), (["read-only"], "d", "n", "query.find"), (["read-only"], "d", "n", "node.put"), ([], "d", "n", "x"), (None, "d", "n", "x")]
    df = spark.createDataFrame(rows, "roles array<string>, database string, namespace string, action string")
    assert [r.allowed for r in X.by_role(df).collect()] == [True, True, False, True, False, False, False]
    assert X.lease(None, 0, 0, "a", 5, 10) == (True, "a", 1, 15)
    assert X.lease("a", 1, 15, "a", 12, 10) == (True, "a", 1, 22)
    assert X.lease("a", 1, 15, "b", 12, 10) == (False, "a", 1, 15)
    assert X.lease("a", 1, 15, "b", 16, 10) == (True, "b", 2, 26)
    mine = X.set_schema_owner({}, "d", "n", 1, 7)
    assert X.set_schema_owner(mine, "d", "n", 2, 1) == {("d", "n"): 2}
    with pytest.raises(X.NotOwner):
        X.set_schema_owner(mine, "d", "n", 2, 2)
    owners = spark.createDataFrame([("d", "n", 1)], "database string, namespace string, site int")
    asked = spark.createDataFrame([("d", "n", 1), ("d", "n", 2), ("d", "m", 2)], "database string, namespace string, site int")
    assert sorted((r.namespace, r.site, r.allowed) for r in X.schema_owner_allows(owners, asked).collect()) == [("m", 2, True), ("n", 1, True), ("n", 2, False)]
