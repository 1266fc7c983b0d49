"""The entry points."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 290 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["l_returnflag", "l_linestatus", "row_count"] and df.count() > 0
