"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from compare import assert_same
from lodestead import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    assert_same(registry.queries()[name](spark, sf), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_loads_without_a_session():
    """A fresh process that has no session yet imports the entry point and lists its queries."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    root = str(Path(__file__).resolve().parent.parent)
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=False)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout.split()[-1]) >= len(registry.queries())
