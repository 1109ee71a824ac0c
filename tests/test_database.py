"""Tables between two databases: even parts, all rows, errors that leave the target alone."""

import uuid

import pytest

from skylattice.__main__ import run
from skylattice.sources.database import Database, Stopped, copy_tables

PROBE = "VALUES 1"


@pytest.fixture
def two(spark):
    made = [Database(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", probe="SELECT 1 AS x FROM SYSIBM.SYSDUMMY1") for _ in range(2)]
    source = made[0]
    source.run("CREATE TABLE POINTS (ID BIGINT, NAME VARCHAR(50))", "CREATE TABLE BAD (ID BIGINT, D DOUBLE)", "CREATE TABLE EMPTY (ID BIGINT)")
    rows = [f"({i if i < 900 else 1_000_000 * i}, 'n{i}')" for i in range(1000)] + ["(NULL, 'none')", "(5, 'again')"]
    source.run("INSERT INTO POINTS VALUES " + ", ".join(rows))
    return made


def test_parts_are_even_and_whole(spark, two):
    source, _ = two
    parts = source.parts("POINTS", "ID", 8)
    assert len(parts) == 9
    sizes = [source.read(f"(SELECT * FROM POINTS WHERE {p}) t").count() for p in parts]
    assert sum(sizes) == 1002
    assert sizes[-1] == 1  # without a key
    assert max(sizes[:-1]) <= 2 * 1001 / 8
    assert source.parts("EMPTY", "ID", 4) == ["ID IS NOT NULL", "ID IS NULL"]


def test_copied(spark, two):
    source, target = two
    made = copy_tables(source, target, [("POINTS", "ID"), ("EMPTY", None)], 4).collect()
    assert [(r["name"], r["rows"], r["parts"]) for r in made] == [("POINTS", 1002, 5), ("EMPTY", 0, 1)]
    assert sorted(map(str, target.read("POINTS").collect())) == sorted(map(str, source.read("POINTS").collect()))
    source.run("DELETE FROM POINTS WHERE ID > 3")
    copy_tables(source, target, [("POINTS", "ID")], 4)  # replaces what is there
    assert target.read("POINTS").count() == 5
    assert {t for t in target.tables() if t.startswith("ZZ_")} == set()


def test_the_first_error_stops(spark, two):
    source, target = two
    target.run("CREATE TABLE POINTS (ID BIGINT, NAME VARCHAR(5))", "INSERT INTO POINTS VALUES (1, 'old')")
    with pytest.raises(Stopped) as stopped:
        copy_tables(source, target, [("EMPTY", "ID"), ("MISSING", "ID"), ("POINTS", "ID")], 2)
    assert stopped.value.name == "MISSING"
    assert [d[0] for d in stopped.value.done] == ["EMPTY"]
    assert [tuple(r) for r in target.read("POINTS").collect()] == [(1, "old")]
    away = Database(spark, "jdbc:derby:memory:nowhere", probe="SELECT 1 AS x FROM SYSIBM.SYSDUMMY1")
    with pytest.raises(ConnectionError):
        copy_tables(source, away, [("POINTS", "ID")])
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever the database says
        target.run("INSERT INTO POINTS VALUES (2, 'new')", "INSERT INTO NOWHERE VALUES (1)")
    assert target.read("POINTS").count() == 1


def test_command(spark, two, capsys):
    source, target = two
    run(spark, ["copy", source.url, target.url, "POINTS:ID", "EMPTY", "--parts", "3", "--probe", "SELECT 1 AS x FROM SYSIBM.SYSDUMMY1"])
    assert target.read("POINTS").count() == 1002
    assert "POINTS" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run(spark, ["copy", source.url, target.url, "NOTHING", "--probe", "SELECT 1 AS x FROM SYSIBM.SYSDUMMY1"])
