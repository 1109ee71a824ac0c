"""Tables copied from one database to another over JDBC: dealt out by quantiles of a key, staged, counted and swapped; the first error stops the run.

The key's quantiles come from one narrow read, so that the parts of the wide one are even however the key is spread; rows without a key are a part of
their own. A table is written beside the target under a name of its own, counted against the source, and only then put in its place, so
an error leaves the target's table as it was. Both databases are asked for an answer before anything is read. Users and passwords come from the environment.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.catalog import jdbc_options, reachable

STAGED, ASIDE = "ZZ_STAGED_{}", "ZZ_ASIDE_{}"
COPIED = "name string, rows long, parts int, seconds double"


class Stopped(RuntimeError):
    """A copy failed; `done` lists what had been copied before, `name` is the table that failed."""

    def __init__(self, name: str, done: list[tuple], why: str) -> None:
        super().__init__(f"{name} wasn't copied: {why[:300]}")
        self.name, self.done = name, done


class Database:
    """A database by its JDBC URL; prefix: of the environment variables with user and password."""

    def __init__(self, spark: SparkSession, url: str, prefix: str = "DB", probe: str | None = None) -> None:
        self.spark, self.url, self.prefix, self.probe = spark, url, prefix, probe

    def options(self, table: str) -> dict[str, str]:
        return jdbc_options(self.url, table, self.prefix)

    def answers(self) -> None:
        """An error unless the database answers."""
        if self.probe is None:
            reachable(self.spark, self.options("x"))
        else:
            try:
                self.spark.read.format("jdbc").options(**self.options(f"({self.probe}) t")).load().first()
            except Exception as e:
                raise ConnectionError(f"the database does not answer: {str(e)[:300]}") from e

    def connected(self, use: Callable[[object], object]) -> object:
        """What use() makes of a connection from the driver, for statements and metadata only: rows go through Spark."""
        own, properties = self.options("x"), self.spark._jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in own:
                properties.setProperty(k, own[k])
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            return use(connection)
        finally:
            connection.close()

    def run(self, *statements: str) -> None:
        """Statements in one transaction: all or none, where the database can undo them."""

        def all_of(connection: object) -> None:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                for s in statements:
                    statement.execute(s)
                connection.commit()
            except Exception:
                connection.rollback()
                raise

        self.connected(all_of)

    def tables(self) -> set[str]:
        """Names of the tables, as the database writes them."""

        def listed(connection: object) -> set[str]:
            found, names = connection.getMetaData().getTables(None, None, "%", None), set()
            while found.next():
                names.add(found.getString("TABLE_NAME"))
            return names

        return self.connected(listed)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(table)).load()

    def parts(self, table: str, key: str, n: int) -> list[str]:
        """Conditions that deal a table's rows into about n even parts, each row into one: by quantiles of a numeric key, and one for rows without."""
        shares = [i / n for i in range(1, n)]
        cuts = self.read(f"(SELECT {key} FROM {table}) t").agg(F.percentile_approx(key, shares, 10_000)).first()[0] if shares else None
        cuts = sorted(set(cuts or []))
        low = [f"{key} > {c}" for c in cuts]
        high = [f"{key} <= {c}" for c in cuts]
        between = [" AND ".join(p for p in pair if p) for pair in zip(["", *low], [*high, ""])]
        return [p or f"{key} IS NOT NULL" for p in between] + [f"{key} IS NULL"]

    def read_in_parts(self, table: str, key: str | None, n: int) -> DataFrame:
        if key is None:
            return self.read(table)
        own = self.options(table)
        return self.spark.read.jdbc(self.url, table, predicates=self.parts(table, key, n), properties={k: v for k, v in own.items() if k not in ("url", "dbtable")})


def copy_table(source: Database, target: Database, table: str, key: str | None = None, parts: int = 16) -> tuple[str, int, int, float]:
    """Replace the target's table by the source's; name, rows, parts and seconds."""
    began = time.perf_counter()
    rows = source.read_in_parts(table, key, parts)
    plain = table.split(".")[-1].upper()
    staged, aside = STAGED.format(plain), ASIDE.format(plain)
    there = target.tables()
    target.run(*[f"DROP TABLE {t}" for t in (staged, aside) if t in there])  # of a run that was lost
    names = rows.toDF(*[c.upper() for c in rows.columns])
    names.write.format("jdbc").options(**target.options(staged)).option("batchsize", "10000").mode("append").save()
    wrote, held = target.read(staged).count(), source.read(f"(SELECT count(*) AS n FROM {table}) t").first()[0]
    if wrote != held:
        raise ValueError(f"{wrote} of {held} rows arrived")
    swap = [f"RENAME TABLE {staged} TO {plain}"]
    if plain in there:
        swap = [f"RENAME TABLE {plain} TO {aside}", *swap, f"DROP TABLE {aside}"]
    target.run(*swap)
    return table, wrote, rows.rdd.getNumPartitions() if key else 1, time.perf_counter() - began


def copy_tables(source: Database, target: Database, tables: Iterable[tuple[str, str | None]], parts: int = 16) -> DataFrame:
    """name, rows, parts and seconds of tables (name, numeric key or None), copied one after another; Stopped at the first error."""
    source.answers()
    target.answers()
    done: list[tuple] = []
    for name, key in tables:
        try:
            done.append(copy_table(source, target, name, key, parts))
        except Exception as e:
            raise Stopped(name, done, str(e)) from e
    return source.spark.createDataFrame(done, COPIED)
