"""Upserts that rewrite only what new keys touch: files that stay, rows as by a dictionary."""

import glob
import os
import random

import pytest

from skylattice.sources.merge import KeyedTable

COLUMNS = "k string, m int, v string, seq long"


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/rows/*/part-*.parquet")}


def part_of(path):
    return int(path.split("part_of_key=")[1].split("/")[0])


def table(spark, path, **options):
    return KeyedTable(spark, f"file://{path}", ["k", "m"], "seq", **options)


def rows_of(kept):
    return sorted(map(tuple, kept.read().select("k", "m", "v", "seq").collect()), key=str)


def test_as_a_dictionary(spark, tmp_path):
    r = random.Random(1)
    kept, mine, lone, seq = table(spark, tmp_path, parts=8, filter_rows=1), {}, [], 0
    for _ in range(4):
        rows = []
        for _ in range(r.choice([0, 5, 300])):
            seq += 1
            row = (r.choice(["", None, *(f"k{i}" for i in range(60))]), r.choice([None, 1, 2, 3, 4, 5]), f"v{seq}", seq)
            rows.append(row)
            if row[0] and row[1] is not None:
                mine[row[:2]] = row
            else:
                lone.append(row)
        kept.upsert(spark.createDataFrame(rows, COLUMNS))
        if mine:
            assert rows_of(kept) == sorted([*mine.values(), *lone], key=str)


def test_untouched_files_stay(spark, tmp_path):
    kept = table(spark, tmp_path, parts=16)
    made = lambda keys, v: spark.createDataFrame([(f"k{i}", 1, v, i) for i in keys], COLUMNS)
    kept.create(made(range(2000), "old"))
    before = files(tmp_path)
    assert len(before) == 16

    done = kept.upsert(made([5, 700], "new"))  # keys that are there
    after = files(tmp_path)
    assert done["added"] == []
    assert 1 <= len(done["rewritten"]) <= 2
    assert {part_of(f) for f in set(before) - set(after)} == set(done["rewritten"])
    assert all(after[f] == before[f] for f in before if part_of(f) not in done["rewritten"])
    assert kept.read().where("v = 'new'").count() == 2

    before, done = after, kept.upsert(made(range(5000, 5003), "fresh"))  # keys that are nowhere: nothing is rewritten but by chance of the filters
    after = files(tmp_path)
    assert len(done["rewritten"]) <= 1
    assert all(after[f] == before[f] for f in before if part_of(f) not in done["rewritten"])
    assert len(after) > len(before) - 1
    assert kept.read().count() == 2003

    done = kept.upsert(made(range(5000, 5003), "again"))  # the filters have learnt them
    assert done["added"] == []
    assert kept.read().where("v = 'again'").count() == 3
    assert kept.read().count() == 2003
    assert len(kept.versions()) == 1


def test_no_key_is_missed(spark, tmp_path):
    """Every part with a known key is found, whatever the filter's size."""
    for size in (1, 3):
        kept = table(spark, tmp_path / str(size), parts=4, filter_rows=size)
        rows = spark.createDataFrame([(f"x{i}", i % 7, "v", i) for i in range(5000)], COLUMNS)
        kept.create(rows)
        assert kept.perhaps_held(kept.dealt(rows)) == [0, 1, 2, 3]
        one = rows.where("k = 'x77'")
        assert kept.perhaps_held(kept.dealt(one)) == [r[0] for r in kept.dealt(one).select("part_of_key").collect()]
        with pytest.raises(ValueError, match="there are rows"):
            kept.create(rows)
