"""Signatures: lists of arguments as databases print them, probes, overloads."""

import pytest
from pyspark.sql import functions as F

from skylattice.operators import signatures

CASES = {
    "": [],
    "  ": [],
    "integer": ["integer"],
    "int4, INT": ["integer", "integer"],
    "p_id integer DEFAULT 0, VARIADIC names character varying(20)[]": ["integer", "character varying[]"],
    "a double precision, double precision": ["double precision", "double precision"],
    "IN a numeric(10,2) = 3.5, OUT b text, INOUT c timestamp(3) with time zone": ["numeric", "timestamp with time zone"],
    "a text DEFAULT 'x, y (z'::text, b date DEFAULT now()": ["text", "date"],
    "a text DEFAULT 'it''s, so', b int8": ["text", "bigint"],
    '"My, name (x)" my_type, q."Other Type"': ["my_type", "q.q"],
    "a int[][], b text array, c int[3]": ["integer[]", "text[]", "integer[]"],
    "x bool DEFAULT coalesce((1 > (2)), f(3, g(4)))": ["boolean"],
    "out a int": [],
    "outer_id int, default_x text, in_x bool": ["integer", "text", "boolean"],
    "a\n  timestamptz ,\tb   float8": ["timestamp with time zone", "double precision"],
}


def test_argument_types(spark):
    df = spark.createDataFrame([*((c,) for c in CASES), (None,)], "args string")
    made = {r["args"]: r["types"] for r in df.withColumn("types", signatures.argument_types(F.col("args"))).collect()}
    assert made == CASES | {None: None}


ROUTINES = "schema string, name string, args string"


def test_probes_tell_overloads_apart(spark):
    there = spark.createDataFrame([("s", "f", "a int4"), ("s", "f", "a text, b integer DEFAULT 1"), ("s", "g", "")], ROUTINES)
    wanted = spark.createDataFrame([("s", "f", "integer"), ("s", "f", "text"), ("s", "f", "string, int"), ("t", "f", "integer"), ("s", "g", ""), ("s", "g", "int")], ROUTINES)
    assert sorted(tuple(r) for r in signatures.known(wanted, there).collect()) == [("s", "f", "integer"), ("s", "f", "string, int"), ("s", "g", "")]


def test_resolution(spark):
    there = spark.createDataFrame([("s", "f", a) for a in ("int", "bigint", "double precision", "text", "text, text", "varchar, text", "text, varchar")], ROUTINES)
    calls = {1: ["integer"], 2: ["smallint"], 3: ["numeric"], 4: ["character"], 5: ["date"], 6: ["character", "character"], 7: ["text", "text"], 8: [], 9: ["character varying", "text"]}
    df = spark.createDataFrame([(k, "s", "f", p) for k, p in calls.items()], "call_id int, schema string, name string, passed array<string>")
    made = {r["call_id"]: r["args"] for r in signatures.resolved(df, there).collect()}
    # 6 fits two of them equally well
    assert made == {1: "int", 2: "int", 3: "double precision", 4: "text", 5: None, 6: None, 7: "text, text", 8: None, 9: "varchar, text"}


def test_overloads_are_copied(spark):
    rows = [("area", "r DOUBLE", "DOUBLE", "r * r * 3"), ("area", "a INT, b INT", "INT", "a * b"), ("area", "s STRING", "INT", "length(s)"), ("once", "x INT", "INT", "x + 1")]
    routines = spark.createDataFrame(rows, "name string, args string, result string, body string")
    made = signatures.copy_functions(spark, routines, "overloads")
    assert made == {"area(double precision)": "area__double_precision", "area(integer, integer)": "area__integer__integer", "area(text)": "area__text", "once(integer)": "once"}
    got = spark.sql("SELECT overloads.area__double_precision(2), overloads.area__integer__integer(3, 4), overloads.area__text('abc'), overloads.once(1)").first()
    assert tuple(got) == (12.0, 12, 3, 2)
    with pytest.raises(ValueError, match="one signature"):
        signatures.copy_functions(spark, routines.unionByName(routines.limit(1).withColumn("args", F.lit("x float8"))), "overloads")
    for own in made.values():
        spark.sql(f"DROP FUNCTION overloads.{own}")
    spark.sql("DROP SCHEMA overloads CASCADE")
