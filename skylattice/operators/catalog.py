"""Catalog objects: listing, existence, definitions, and copying tables, views and functions between schemas."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.sources.sinks import save_table

log = logging.getLogger(__name__)
OBJECTS = "schema string, name string, kind string"


def objects(spark: SparkSession, schemas: Iterable[str]) -> DataFrame:
    """schema, name, kind (table, view or function) of everything in some schemas; metadata only."""
    found = []
    for schema in schemas:
        found += [(schema, t.name, "view" if t.tableType.endswith("VIEW") else "table") for t in spark.catalog.listTables(schema) if t.tableType != "TEMPORARY"]
        found += [(schema, f.name, "function") for f in spark.catalog.listFunctions(schema) if f.namespace]
    return spark.createDataFrame(found, OBJECTS).orderBy("schema", "name")


def known(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted objects that exist."""
    return wanted.join(there, keys, "left_semi")


def missing(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted objects that don't exist."""
    return wanted.join(there, keys, "left_anti")


def definitions(routines: DataFrame, namespaces: DataFrame) -> DataFrame:
    """schema, name, args, definition of routines(namespace_id, ...) by their namespace (a small table)."""
    return routines.join(namespaces, "namespace_id").select("schema", "name", "args", "definition").orderBy("schema", "name", "args")


def jdbc_options(url: str, table: str, prefix: str = "DB", column: str | None = None, low: int = 0, high: int = 0, parts: int = 16) -> dict[str, str]:
    """Options of a JDBC read, dealt over tasks by a numeric column. User and password come from the environment alone."""
    found = {"url": url, "dbtable": table, "fetchsize": "10000"}
    found |= {k: os.environ[f"{prefix}_{k.upper()}"] for k in ("user", "password") if f"{prefix}_{k.upper()}" in os.environ}
    if column:
        found |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return found


def sync_tables(spark: SparkSession, names: Iterable[str], source: str, target: str, clean: bool = True) -> DataFrame:
    """Copy tables from one schema to another; name, rows, seconds of each. clean: replace the target, else append."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    done = []
    for name in names:
        began = time.perf_counter()
        before = 0 if clean or not spark.catalog.tableExists(f"{target}.{name}") else spark.table(f"{target}.{name}").count()
        wrote = save_table(spark.table(f"{source}.{name}"), f"{target}.{name}", mode="overwrite" if clean else "append")  # counted as they are written
        done.append((name, before + wrote, time.perf_counter() - began))
        log.info("copied %s: %d rows in %.2f s", *done[-1])
    return spark.createDataFrame(done, "name string, rows long, seconds double")


def in_order(uses: Mapping[str, set[str]]) -> list[str]:
    """Names such that each comes after those it uses; ties by name. A circle is an error."""
    left, found = {n: {u for u in us if u in uses and u != n} for n, us in uses.items()}, []
    while left:
        free = sorted(n for n, us in left.items() if not us)
        if not free:
            raise ValueError(f"views use one another in a circle: {sorted(left)}")
        found += free
        left = {n: us - set(free) for n, us in left.items() if n not in free}
    return found


def relations(spark: SparkSession, body: str) -> set[tuple[str, ...]]:
    """The tables and views that a statement reads, by their parts of names, as Spark's parser finds them: not its common table expressions, nor names in literals or comments."""
    found: set[tuple[str, ...]] = set()

    def items(seq: object) -> list:
        it = seq.iterator()
        return [it.next() for _ in iter(it.hasNext, False)]

    def walk(node: object, named: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = tuple(str(p).lower() for p in items(node.multipartIdentifier()))
            if len(parts) > 1 or parts[0] not in named:
                found.add(parts)
        elif kind == "UnresolvedWith":
            for cte in items(node.cteRelations()):  # each sees those before it
                walk(cte._2(), named)
                named = named | {str(cte._1()).lower()}
        for child in items(node.children()):
            walk(child, named)
        if hasattr(node, "expressions") and kind.isidentifier():
            for e in items(node.expressions()) if _is_plan(node) else []:
                walk(e, named)
        if not _is_plan(node) and _holds_plan(node):
            walk(node.plan(), named)

    sub = spark._jvm.org.apache.spark.sql.catalyst

    def _is_plan(node: object) -> bool:
        return spark._jvm.java.lang.Class.forName(sub.plans.logical.LogicalPlan._fqn).isInstance(node)

    def _holds_plan(node: object) -> bool:
        return spark._jvm.java.lang.Class.forName(sub.expressions.SubqueryExpression._fqn).isInstance(node)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(body), frozenset())
    return found


def sync_views(spark: SparkSession, bodies: Mapping[str, str], target: str) -> list[str]:
    """Create views from their SELECT statements, each after the views it reads; the order taken. A name without a schema means one of the target's."""
    low = {n.lower(): n for n in bodies}
    own = lambda parts: parts[-1] in low and (len(parts) == 1 or parts[-2] == target.split(".")[-1].lower())
    order = in_order({n: {low[p[-1]] for p in relations(spark, body) if own(p)} for n, body in bodies.items()})
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(target)
    try:
        for name in order:
            spark.sql(f"CREATE OR REPLACE VIEW {name} AS {bodies[name]}")
    finally:
        spark.catalog.setCurrentDatabase(before)
    return order


def view_bodies(spark: SparkSession, names: Iterable[str], schema: str) -> dict[str, str]:
    """The SELECT statements of views; metadata only."""
    described = {n: spark.sql(f"DESCRIBE EXTENDED {schema}.{n}").where("col_name = 'View Text'").first() for n in names}
    return {n: r["data_type"] for n, r in described.items() if r}


def function_signatures(spark: SparkSession, names: Iterable[str], schema: str) -> dict[str, str]:
    """name -> arguments, result and body of SQL functions, as sync_functions() takes them; metadata only. Other functions are left out."""
    found = {}
    for name in names:
        usage = [r[0] for r in spark.sql(f"DESCRIBE FUNCTION EXTENDED {schema}.{name}").collect() if r[0].startswith("Usage: {")]  # one object's description
        if usage:
            d = json.loads(usage[0].removeprefix("Usage: "))
            part = lambda k: d.get(f"sqlFunction.{k}", "")  # noqa: B023, E731
            result = f"TABLE({part('returnType')})" if part("isTableFunc") == "true" else part("returnType")
            found[name] = f"({part('inputParam')}) RETURNS {result} RETURN {part('expression') or part('query')}"
    return found


def reachable(spark: SparkSession, options: Mapping[str, str]) -> None:
    """An error unless the database of jdbc_options() answers: asked before anything is written."""
    try:
        spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k in ("url", "user", "password", "driver")}).option("dbtable", "(VALUES (1)) AS t(x)").load().first()
    except Exception as e:
        raise ConnectionError(f"the target does not answer: {str(e)[:300]}") from e


def answering(spark: SparkSession, schema: str) -> None:
    """An error unless the catalog that a schema belongs to answers: asked before anything is written."""
    outer = schema.rpartition(".")[0]
    try:
        spark.sql(f"SHOW SCHEMAS IN {outer}" if outer else "SHOW SCHEMAS").first()
    except Exception as e:
        raise ConnectionError(f"the catalog of {schema} does not answer: {str(e)[:300]}") from e


def sync_functions(spark: SparkSession, signatures: Mapping[str, str], target: str) -> list[str]:
    """Create SQL functions: name -> everything after the name (`(x INT) RETURNS INT RETURN x + 1`)."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    for name, rest in sorted(signatures.items()):
        spark.sql(f"CREATE OR REPLACE FUNCTION {target}.{name}{rest}")
    return sorted(signatures)


def chosen(configured: list[str], there: DataFrame, kind: str) -> list[str]:
    """The configured names, or all objects of a kind where none are."""
    return configured or [r["name"] for r in there.where(F.col("kind") == kind).orderBy("name").collect()]  # names of catalog objects, not data
