import pytest
from oracle import compare

from graphloom import block_queries as B
from graphloom import graph_queries as G
from graphloom import log_queries as L
from graphloom.functions.cel import CelSyntaxError, CelTypeError, compile_cel

SF = "/root/testdata/sf0.001"


QUERIES, SQL = G.QUERIES | B.QUERIES | L.QUERIES, G.ORACLE_SQL | B.ORACLE_SQL | L.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize(
    ("cel", "want"),
    [("age >= 30", "ACE"), ("city == 'San Francisco' && age < 30", "B"), ("city == 'Austin' || age >= 36", "DE"), ("city == 'San'", ""), ("city > 5", ""), ("!(age >= 30)", "BD"), ("age in [27, 29]", "BD"), ("name.startsWith('A')", "A"), ("nope == null", "ABCDE"), ("age + 1 == 35", "A")],
)
def test_cel(spark, cel, want):
    people = spark.createDataFrame([("Alice", 34, "San Francisco"), ("Bob", 29, "San Francisco"), ("Carol", 31, "New York"), ("Dan", 27, "Austin"), ("Eve", 36, "Seattle")], "name string, age long, city string")
    assert "".join(sorted(r.name[0] for r in people.where(compile_cel(cel, people.schema)).collect())) == want


def test_cel_errors(spark):
    schema = spark.range(1).schema
    with pytest.raises(CelSyntaxError):
        compile_cel("id >=", schema)
    with pytest.raises(CelTypeError):
        compile_cel("id + 1", schema)


def test_find_customers_is_whole(spark, tmp_path):
    """More rows than a page holds, in id order."""
    spark.range(1500).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "6000.0D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r.c_custkey for r in G.find_customers(spark, str(tmp_path)).collect()] == list(range(1500))


def test_retention_drops_rows(spark, tmp_path):
    """Some rows go, and only those that are both old and below the checkpoint."""
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert 0 < G.log_retention_by_age(spark, SF).count() < events
    rows = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-31 00:00:00' - make_dt_interval(int(day)) AS ts FROM VALUES (0L, 20), (1L, 5), (2L, 10), (3L, 11), (8L, 20), (10L, 0) AS t(id, day)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in G.log_retention_by_age(spark, str(tmp_path)).collect()) == [1, 2, 8, 10]
