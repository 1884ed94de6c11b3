"""The Python-worker parts must run where executors have no copy of the package."""

import os
import subprocess
import sys
import tempfile

from tests.conftest import ROOT, SF001

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
n = E.queries()["q36_page_tables"](spark, {SF001!r}).count()
print("ROWS", n)
"""


def test_page_parser_runs_without_package_on_workers():
    d = tempfile.mkdtemp(prefix="pinax-ship-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True,
                       text=True, timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-3000:]
    assert int(r.stdout.split("ROWS")[1].split()[0]) > 0
