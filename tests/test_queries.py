"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os
import subprocess
import sys

import pytest
from compare import TESTDATA, connect, difference

import __spark_entry__ as entry
from meibo.plans.catalogue import QUERIES
from meibo.plans.oracle import ORACLE_SQL

SF = "0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, f"{TESTDATA}/sf{SF}")
    assert difference(got, con, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["meibo.llm", "corpus_pipeline", "ahocorasick", "sentencepiece"])
def test_text_operators_may_be_left_out(missing):
    """Without the subpackage, or a library that only it needs, the other queries are still there."""
    code = f"""
import sys, importlib.abc
class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from meibo.plans.catalogue import QUERIES
print(set(entry.queries()) == set(QUERIES) == set(entry.oracle_sql()))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr
    assert "without the text operators" in done.stderr


def test_a_missing_module_of_the_library_is_an_error():
    code = "import sys; sys.modules['meibo.operators.fill'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode and "meibo.operators.fill" in done.stderr
