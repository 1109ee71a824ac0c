"""Batches of catalog objects: all or nothing, and the order of views."""

import pytest
from pyspark.sql import functions as F

from skylattice.operators import batch, catalog


@pytest.fixture
def schema(spark):
    spark.sql("DROP SCHEMA IF EXISTS batches CASCADE")
    spark.sql("CREATE SCHEMA batches")
    yield "batches"
    for f in ("twice", "wrong"):  # a dropped schema's functions stay known to the session
        spark.sql(f"DROP FUNCTION IF EXISTS batches.{f}")
    spark.sql("DROP SCHEMA batches CASCADE")


def state(spark, schema):
    """Everything there: rows of tables and views, results of functions."""
    seen = {t.name: sorted(map(tuple, spark.table(f"{schema}.{t.name}").collect())) for t in spark.catalog.listTables(schema) if t.tableType != "TEMPORARY"}
    return seen | {f.name: spark.sql(f"SELECT {schema}.{f.name}(1)").first()[0] for f in spark.catalog.listFunctions(schema) if f.namespace}


def first(spark, schema):
    b = batch.Batch(spark, schema).table("points", spark.range(3)).table("zones", spark.range(2).withColumn("k", F.lit("a/b='c'")), by=("k",))
    return b.function("twice", "(x INT) RETURNS INT RETURN x * 2").view("both", "SELECT count(*) AS n FROM points, zones").view("more", "SELECT n + batches.twice(1) AS n FROM both").commit()


def test_all_at_once(spark, schema):
    assert first(spark, schema) == {"points": 3, "zones": 2}
    assert state(spark, schema) == {"points": [(0,), (1,), (2,)], "zones": [(0, "a/b='c'"), (1, "a/b='c'")], "twice": 2, "both": [(6,)], "more": [(8,)]}
    batch.Batch(spark, schema).table("points", spark.range(1), check=lambda df: df.count() == 1).function("twice", "(x INT) RETURNS INT RETURN x * 20").commit()
    assert state(spark, schema) == {"points": [(0,)], "zones": [(0, "a/b='c'"), (1, "a/b='c'")], "twice": 20, "both": [(2,)], "more": [(22,)]}


def broken(spark):
    """Rows that fail when they are written."""
    return spark.range(5).select(F.raise_error(F.lit("no row")).cast("long").alias("id"))


CASES = {
    "a table's rows": lambda s, b: b.table("zones", broken(s)),
    "a check": lambda s, b: b.table("zones", s.range(9), check=lambda df: df.count() == 8),
    "a view": lambda s, b: b.table("zones", s.range(9)).view("more", "SELECT nothing FROM points"),
    "a new view after others": lambda s, b: b.view("aa", "SELECT 1 AS x").view("both", "SELECT 5 AS n").view("zz", "SELECT * FROM not_there"),
    "views in a circle": lambda s, b: b.view("v", "SELECT * FROM w").view("w", "SELECT * FROM v"),
    "a function": lambda s, b: b.function("twice", "(x INT) RETURNS INT RETURN x * 3").function("wrong", "(x INT) RETURNS INT RETURN y"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_nothing_is_left_of_a_failure(spark, schema, name):
    first(spark, schema)
    before = state(spark, schema)
    b = batch.Batch(spark, schema).table("points", spark.range(100)).table("fresh", spark.range(4))
    with pytest.raises(batch.NotSwapped):
        CASES[name](spark, b).commit()
    assert state(spark, schema) == before


@pytest.mark.parametrize("done", [False, True])
def test_a_lost_driver(spark, schema, done):
    first(spark, schema)
    before = state(spark, schema)
    b = batch.Batch(spark, schema).table("points", spark.range(100)).table("fresh", spark.range(4)).table("late", spark.range(1))
    b.stage()
    lost = b.tables.pop()  # the driver is lost before the last one's turn
    if done:
        b.tables.append(lost)
    b.swap([])
    if done:
        spark.sql(f"CREATE TABLE {b.own(batch.DONE)} (x INT) USING parquet")
    assert batch.recover(spark, schema) == {b.key: "finished" if done else "undone"}
    after = state(spark, schema)
    if done:
        assert (len(after["points"]), len(after["fresh"]), len(after["late"])) == (100, 4, 1)
    else:
        assert after == before
    assert batch.recover(spark, schema) == {}


def test_relations_of_statements(spark):
    cases = {
        "SELECT 'FROM a' AS x, `b` FROM c -- d\n JOIN s.e /* f */ ON c.g = e.g": {("c",), ("s", "e")},
        "WITH a AS (SELECT * FROM b), c AS (SELECT * FROM a) SELECT * FROM c JOIN d USING (k)": {("b",), ("d",)},
        "SELECT (SELECT max(x) FROM a) FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.k = b.k) AND k IN (SELECT k FROM d)": {("a",), ("b",), ("c",), ("d",)},
        "SELECT * FROM (SELECT * FROM A UNION ALL SELECT * FROM (WITH z AS (SELECT 1) SELECT * FROM z)) t": {("a",)},
        "SELECT 1": set(),
    }
    assert {body: catalog.relations(spark, body) for body in cases} == cases


def test_views_named_in_literals(spark, schema):
    """Split by spaces, each of these would use the other."""
    bodies = {"a": "SELECT 'b' AS k, ' from b ' AS l -- b", "b": "SELECT k /* a */ FROM a"}
    assert catalog.sync_views(spark, bodies, schema) == ["a", "b"]
    assert [tuple(r) for r in spark.table("batches.b").collect()] == [("b",)]
