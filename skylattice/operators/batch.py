"""Several catalog objects changed together: staged, checked, swapped; undone if anything fails.

Tables are first written under names of their own and checked there, while readers still see the old ones. Then each is renamed into
place, the old one put aside; views and functions are created after the tables, their old definitions kept. A failure puts everything
back in reverse order. What a batch has done is visible in the catalog by names alone, so that recover() can finish or undo a batch whose driver
was lost: a batch with its `done` table is finished, any other is undone.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from skylattice.operators import catalog
from skylattice.sources.sinks import save_table

log = logging.getLogger(__name__)
#: What names of a batch's own tables begin with: those to come, those put aside, marks of names that were free, and the mark of the end.
STAGED, ASIDE, FREE, DONE = "zz_staged_", "zz_aside_", "zz_free_", "zz_done_"


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table. Catalogs that leave the partitions of a renamed table at their old place have them found again, before anything else can be put there."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {new}").collect()}  # one object's description
    if "# Partition Information" not in described:
        return
    quoted = lambda v: "'" + unquote(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = [[p.partition("=") for p in r[0].split("/")] for r in spark.sql(f"SHOW PARTITIONS {new}").collect()]  # names of partitions
    specs = [", ".join(f"`{k}` = {quoted(v)}" for k, _, v in p) for p in parts]
    if not specs:
        return
    at = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {new} PARTITION ({specs[0]})").collect() if r["col_name"] == "Location")  # the table's own comes later
    if not at.startswith(described["Location"] + "/"):
        spark.sql(f"ALTER TABLE {new} DROP " + ", ".join(f"PARTITION ({s})" for s in specs))
        spark.sql(f"MSCK REPAIR TABLE {new}")


class NotSwapped(RuntimeError):
    """A batch failed and was undone."""


@dataclass
class Batch:
    """Changes to one schema. Add them, then commit(); nothing is visible before."""

    spark: SparkSession
    schema: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    tables: list[tuple[str, DataFrame, tuple[str, ...], Callable[[DataFrame], bool] | None]] = field(default_factory=list)
    functions: dict[str, str] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def table(self, name: str, df: DataFrame, by: tuple[str, ...] = (), check: Callable[[DataFrame], bool] | None = None) -> Batch:
        """Replace or create a table, partitioned by some columns. check: of the staged table; anything but True ends the batch."""
        if any(name == t[0] for t in self.tables):
            raise ValueError(f"{name} twice in one batch")
        self.tables.append((name, df, by, check))
        return self

    def function(self, name: str, rest: str) -> Batch:
        """Replace or create a SQL function: everything after its name."""
        self.functions[name] = rest
        return self

    def view(self, name: str, body: str) -> Batch:
        """Replace or create a view by its SELECT statement; it may use the batch's tables, functions and other views."""
        self.views[name] = body
        return self

    def own(self, kind: str, name: str = "") -> str:
        return f"{self.schema}.{kind}{self.key}" + (f"_{name}" if name else "")

    def stage(self) -> dict[str, int]:
        """Write and check all tables; rows of each."""
        rows = {}
        for name, df, by, check in self.tables:
            rows[name] = save_table(df, self.own(STAGED, name), by=by)
            if check is not None and check(self.spark.table(self.own(STAGED, name))) is not True:
                raise ValueError(f"{name} doesn't pass its check")
        return rows

    def swap(self, undo: list[Callable[[], object]]) -> None:
        """Put everything in place; undo grows by what takes each step back."""
        sql, there = self.spark.sql, self.spark.catalog.tableExists
        for name, *_ in self.tables:
            full = f"{self.schema}.{name}"
            if there(full):
                rename(self.spark, full, self.own(ASIDE, name))
                undo.append(lambda full=full, name=name: rename(self.spark, self.own(ASIDE, name), full))
            else:
                sql(f"CREATE TABLE {self.own(FREE, name)} (x INT) USING parquet")
                undo.append(lambda name=name: sql(f"DROP TABLE IF EXISTS {self.own(FREE, name)}"))
            rename(self.spark, self.own(STAGED, name), full)
            undo.append(lambda full=full: sql(f"DROP TABLE IF EXISTS {full}"))
        before = {f.name for f in self.spark.catalog.listFunctions(self.schema) if f.namespace} & set(self.functions)
        old = catalog.function_signatures(self.spark, sorted(before), self.schema)
        if before - set(old):
            raise ValueError(f"no SQL functions, so they could not be put back: {sorted(before - set(old))}")
        for name, rest in sorted(self.functions.items()):
            undo.append(lambda n=name: sql(f"CREATE OR REPLACE FUNCTION {self.schema}.{n}{old[n]}" if n in old else f"DROP FUNCTION IF EXISTS {self.schema}.{n}"))
            sql(f"CREATE OR REPLACE FUNCTION {self.schema}.{name}{rest}")
        bodies = catalog.view_bodies(self.spark, [v for v in self.views if there(f"{self.schema}.{v}")], self.schema)
        undo.append(lambda: catalog.sync_views(self.spark, {v: b for v, b in bodies.items()}, self.schema))
        undo.append(lambda: [sql(f"DROP VIEW IF EXISTS {self.schema}.{v}") for v in self.views if v not in bodies])
        catalog.sync_views(self.spark, self.views, self.schema)

    def drop_own(self) -> None:
        """Drop what the batch has put beside its objects."""
        for t in self.spark.catalog.listTables(self.schema):
            if any(t.name.startswith(f"{kind}{self.key}") for kind in (STAGED, ASIDE, FREE)):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.schema}.{t.name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.own(DONE)}")

    def commit(self) -> dict[str, int]:
        """All changes or none; rows of each table. NotSwapped says what went wrong."""
        undo: list[Callable[[], object]] = []
        try:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema}")
            rows = self.stage()
            self.swap(undo)
            self.spark.sql(f"CREATE TABLE {self.own(DONE)} (x INT) USING parquet")
        except Exception as e:
            log.warning("the batch on %s is undone: %s", self.schema, e)
            for step in reversed(undo):
                step()
            self.drop_own()
            raise NotSwapped(f"nothing of the batch on {self.schema} is left: {str(e)[:300]}") from e
        self.drop_own()
        return rows


def recover(spark: SparkSession, schema: str) -> dict[str, str]:
    """Finish or undo batches whose driver was lost: key -> finished or undone. Tables only; views and functions can be created again by the next batch.

    Run it while no batch runs on the schema.
    """
    names = [t.name for t in spark.catalog.listTables(schema)]
    keys = {n[len(kind) :].split("_")[0] for n in names for kind in (STAGED, ASIDE, FREE, DONE) if n.startswith(kind)}
    found = {}
    for key in sorted(keys):
        batch = Batch(spark, schema, key)
        if f"{DONE}{key}" in names:
            found[key] = "finished"
        else:
            found[key] = "undone"
            staged = {n.removeprefix(f"{STAGED}{key}_") for n in names if n.startswith(f"{STAGED}{key}_")}
            for kind in (ASIDE, FREE):
                for own in [n for n in names if n.startswith(f"{kind}{key}_")]:
                    name = own.removeprefix(f"{kind}{key}_")
                    if name not in staged:  # it had been renamed into place
                        spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
                    if kind == ASIDE:
                        rename(spark, f"{schema}.{own}", f"{schema}.{name}")
        batch.drop_own()
    return found
