"""The driver contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from skylattice.plans import geo_queries

REPO = Path(entry.__file__).parent


def test_names():
    assert set(geo_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["type_code", "n", "percentage"]


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "skylattice", tmp_path / "skylattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(geo_queries.QUERIES)), str(len(geo_queries.ORACLES))], done.stderr[-500:]
