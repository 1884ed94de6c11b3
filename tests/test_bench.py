"""bench.py prints one JSON line with the keys the driver reads."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_REPEATS="1", BENCH_CPUS="2", BENCH_ONLY="q0|q33")
    r = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                       capture_output=True, text=True, timeout=900)
    assert r.returncode == 0, r.stderr[-3000:]
    lines = [ln for ln in r.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    import __spark_entry__ as E
    assert set(d["queries"]) == {q for q in E.queries() if q.startswith(("q0", "q33"))} and d["unit"] == "sec" and d["sf"] == 0.001
    assert d["errors"] == {} and all(v is not None for v in d["queries"].values())
