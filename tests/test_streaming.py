import csv
import os
import uuid

from pinax.streaming import deliveries
from tests.fixtures import HEADERS, delivery_sheets


def _export(folder, sheets, years, suffix=""):
    os.makedirs(folder, exist_ok=True)
    for y in years:
        rows = sheets[str(y)][6:]            # header row onwards
        with open(os.path.join(folder, f"{y}{suffix}.csv"), "w", newline="") as f:
            w = csv.writer(f)
            for r in rows:
                w.writerow(["" if v is None else v for v in (list(r) + [None] * 4)[:4]])


def test_stream_of_deliveries(spark, tmpdir_path):
    sheets = delivery_sheets()
    src = os.path.join(tmpdir_path, "in")
    out = os.path.join(tmpdir_path, "out")
    _export(src, sheets, [2010, 2011])
    name = f"deliveries_{uuid.uuid4().hex[:8]}"
    raw = deliveries.read_deliveries(spark, src, HEADERS, max_files=1)
    q = deliveries.start(raw, out, name=name)
    q.awaitTermination(120)
    panel = spark.read.parquet(f"{out}/panel")
    assert panel.count() == 8 and {r.year for r in panel.select("year").collect()} == {2010, 2011}
    assert spark.read.parquet(f"{out}/country").count() == 2
    # a later delivery is picked up by the next run; earlier files are not re-read
    _export(src, sheets, [2012])
    q = deliveries.start(deliveries.read_deliveries(spark, src, HEADERS), out, name=name)
    q.awaitTermination(120)
    panel = spark.read.parquet(f"{out}/panel")
    assert panel.count() == 8 + 5
    assert panel.filter("locality = 'Esch-sur-Alzette'").count() == 3


def test_redelivered_year_is_reported_and_replaces(spark, tmpdir_path):
    sheets = delivery_sheets()
    src = os.path.join(tmpdir_path, "in")
    out = os.path.join(tmpdir_path, "out")
    _export(src, sheets, [2010, 2011])
    name = f"deliveries_{uuid.uuid4().hex[:8]}"
    deliveries.start(deliveries.read_deliveries(spark, src, HEADERS), out, name=name).awaitTermination(120)
    # 2011 delivered again under a new file name, with Mamer's price revised and Esch dropped
    fixed = [list(r) for r in sheets["2011"]]
    fixed = [r for r in fixed if not (r and isinstance(r[0], str) and "Esch" in r[0])]
    for r in fixed:
        if r and r[0] == "Mamer":
            r[2] = 1.0
    _export(src, {"2011": [[]] * 6 + fixed[6:]}, [2011], suffix="b")
    raw = deliveries.read_deliveries(spark, src, HEADERS, sheet_pattern=r"(\d{4})[a-z]*\.csv$")
    deliveries.start(raw, out, name=name).awaitTermination(120)
    rev = {(r.locality, r.kind) for r in spark.read.parquet(f"{out}/revisions").collect()}
    assert rev == {("Mamer", "changed"), ("Esch-sur-Alzette", "removed")}
    latest = deliveries.latest_panel(spark, out)
    assert latest.filter("year = 2011").count() == 3
    assert latest.filter("year = 2010").count() == 4
    # a third delivery of 2011 is compared with the second one only
    third = [list(r) for r in fixed if not (r and r[0] == "Mamer")]
    _export(src, {"2011": third}, [2011], suffix="c")
    deliveries.start(raw, out, name=name).awaitTermination(120)
    batches = sorted(int(f.split("=")[1]) for f in os.listdir(f"{out}/revisions") if f.startswith("batch="))
    last = spark.read.parquet(f"{out}/revisions/batch={batches[-1]}")
    assert {(r.locality, r.kind) for r in last.collect()} == {("Mamer", "removed")}
