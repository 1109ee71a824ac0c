"""Signatures of routines: argument lists as normalised types, existence by signature, overloads resolved and copied.

An argument list is what a database prints: modes, names, types with modifiers, defaults. As a signature only the types of the arguments
that are passed in count, under one spelling each. All of it is column functions, so a catalog of any size is normalised and probed
by joins. Spark keeps one function a name; overloads of a name are created under names of their own, made from their types.

Defined results: null arguments give null, an empty list an empty array. Names in double quotes and literals in defaults may hold commas, brackets and
the words of the grammar. A type that isn't known counts as it is written, in small letters. Of two words the first is a name unless both
together are a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of types and what they stand for.
TYPES = {
    "bigint": "bigint", "int8": "bigint", "long": "bigint", "integer": "integer", "int": "integer", "int4": "integer", "smallint": "smallint", "int2": "smallint",
    "double precision": "double precision", "float8": "double precision", "float": "double precision", "double": "double precision", "real": "real", "float4": "real",
    "numeric": "numeric", "decimal": "numeric", "boolean": "boolean", "bool": "boolean", "text": "text", "string": "text",
    "character varying": "character varying", "varchar": "character varying", "character": "character", "char": "character", "bpchar": "character",
    "bit varying": "bit varying", "varbit": "bit varying", "bytea": "bytea", "binary": "bytea", "date": "date", "uuid": "uuid", "json": "json", "jsonb": "jsonb",
    "timestamp without time zone": "timestamp without time zone", "timestamp": "timestamp without time zone", "timestamp with time zone": "timestamp with time zone", "timestamptz": "timestamp with time zone",
    "time without time zone": "time without time zone", "time": "time without time zone", "time with time zone": "time with time zone", "timetz": "time with time zone",
}
#: Groups of types, each of which is converted to any later one of its group by itself.
WIDENING = (("smallint", "integer", "bigint", "numeric", "real", "double precision"), ("character", "character varying", "text"), ("date", "timestamp without time zone", "timestamp with time zone"))
#: Patterns in the order they are used; the last of the brackets go by as many rounds as they nest.
LITERAL, QUOTED, BRACKETS, DEFAULT, MODE, ARRAY = r"'([^']|'')*'", r'"([^"]|"")*"', r"\([^()]*\)", r"\s*(:=|=|\bdefault\b).*$", r"^(in out|inout|in|out|variadic)\s+", r"(\s*\[\d*\])+$|\s+array$"
DEPTH = 4


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def argument_types(args: Column) -> Column:
    """The normalised types of the arguments that are passed in: array of strings."""
    flat = F.lower(replaced(replaced(args, LITERAL, "''"), QUOTED, "q"))
    for _ in range(DEPTH):
        flat = replaced(flat, BRACKETS, "")
    spellings = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def one(arg: Column) -> Column:
        words = F.trim(replaced(arg, r"\s+", " "))
        words = replaced(F.trim(replaced(words, DEFAULT, "")), MODE, "")
        many = F.when(words.rlike(ARRAY), F.lit("[]")).otherwise(F.lit(""))
        bare = F.trim(replaced(words, ARRAY, ""))
        unnamed = replaced(bare, r"^\S+\s+", "")
        kind = F.coalesce(F.try_element_at(spellings, bare), F.try_element_at(spellings, unnamed), unnamed)
        return F.concat(kind, many)

    passed = F.filter(F.split(flat, ","), lambda a: (F.trim(a) != "") & ~F.trim(a).rlike(r"^out\s"))
    return F.transform(passed, one)


def signature(name: Column, args: Column) -> Column:
    """`name(type, type)`."""
    return F.concat(name, F.lit("("), F.array_join(argument_types(args), ", "), F.lit(")"))


def with_types(routines: DataFrame) -> DataFrame:
    return routines.withColumn("types", argument_types(F.col("args")))


def known(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The wanted(schema, name, args) routines that exist with this signature, however it is spelt; each name's other overloads don't count."""
    keys = ["schema", "name", "types"]
    return with_types(wanted).join(with_types(there).select(*keys).distinct(), keys, "left_semi").drop("types")


def resolved(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """calls(call_id, schema, name, passed: array of types) with the one routine that fits best: its args and types, or null where none does, or several do as well.

    A type that is the argument's own counts most, one that is converted by itself less (the nearer the better); no other fits.
    """
    # every pair that is converted, with what it costs: a few dozen
    costs = {f"{a}>{b}": j - i for group in WIDENING for i, a in enumerate(group) for j, b in enumerate(group) if i < j} | {f"unknown>{t}": 10 for t in set(TYPES.values())}
    table = F.create_map(*[F.lit(x) for pair in costs.items() for x in pair])
    pair = lambda p, t: F.when(p == t, F.lit(0)).otherwise(F.try_element_at(table, F.concat(p, F.lit(">"), t)))
    kinds = with_types(routines).withColumn("n", F.size("types"))
    tried = calls.withColumn("n", F.size("passed")).join(kinds, ["schema", "name", "n"])
    cost = F.aggregate(F.zip_with("passed", "types", pair), F.lit(0), lambda total, c: total + c)  # null where one does not fit
    fits = tried.withColumn("cost", cost).where("cost IS NOT NULL")
    best = fits.groupBy("call_id").agg(F.min("cost").alias("cost"))
    level = fits.join(best, ["call_id", "cost"]).groupBy("call_id").agg(F.count(F.lit(1)).alias("as_good"), F.min(F.struct("args", "types")).alias("r"))
    chosen = level.where("as_good = 1").select("call_id", F.col("r.args").alias("args"), F.col("r.types").alias("types"))
    return calls.join(chosen, "call_id", "left")


def own_name(name: str, types: list[str], overloaded: bool) -> str:
    """What an overload is called in Spark: its types behind its name, letters and digits only."""
    if not overloaded:
        return name
    plain = ["".join(c if c.isalnum() else "_" for c in t.replace("[]", "_array")) for t in types]
    return "__".join([name, *plain]) if plain else f"{name}__"


def copy_functions(spark: SparkSession, routines: DataFrame, target: str) -> dict[str, str]:
    """Create the SQL functions of routines(name, args, result, body) in a schema: signature -> name there. Overloads of a name are all created, each under its own.

    Routines are catalog objects, so they are listed on the driver.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    rows = with_types(routines).withColumn("signature", signature(F.col("name"), F.col("args"))).orderBy("signature").collect()
    twice = [r["signature"] for a, r in zip(rows, rows[1:]) if a["signature"] == r["signature"]]
    if twice:
        raise ValueError(f"one signature for several routines: {twice[0]}")
    names = [r["name"] for r in rows]
    made = {}
    for r in rows:
        own = own_name(r["name"], r["types"], names.count(r["name"]) > 1)
        spark.sql(f"CREATE OR REPLACE FUNCTION {target}.{own}({r['args']}) RETURNS {r['result']} RETURN {r['body']}")
        made[r["signature"]] = own
    return made
