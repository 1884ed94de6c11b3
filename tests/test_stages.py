"""Q22: the reference's three steps end to end on synthetic deliveries."""

import os

import pytest
from pyspark.sql import functions as F

from pinax.plans import stages
from pinax.sources import html, workbook
from tests.fixtures import HEADERS, commune_pages, delivery_sheets, write_xlsx


@pytest.fixture(scope="module")
def cleaned(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="pinax-wb-", dir="/tmp")
    path = os.path.join(d, "deliveries.xlsx")
    write_xlsx(path, delivery_sheets())
    raw = workbook.sheet_frame(workbook.read_workbooks(spark, path, skip_rows=6, header=HEADERS), HEADERS)
    return stages.clean_deliveries(raw)


def test_panel(cleaned):
    p = cleaned.panel
    assert p.columns == stages.PANEL_COLUMNS
    rows = p.collect()
    assert len(rows) == 4 * 2 + 5 * 10
    assert {r.locality for r in rows} == {"Esch-sur-Alzette", "Luxembourg", "Pétange", "Mamer", "Schengen"}
    pet = [r for r in rows if r.locality == "Pétange"]
    assert all(r.average_price_nominal_euros is None for r in pet)
    assert all(r.average_price_m2_nominal_euros is not None for r in pet)
    assert dict(p.dtypes)["year"] == "int" and dict(p.dtypes)["n_offers"] == "bigint"


def test_classes_partition_rows(cleaned):
    c = cleaned.classified
    counts = {r.row_class: r["count"] for r in c.groupBy("row_class").count().collect()}
    assert sum(counts.values()) == c.count() == 118
    assert counts == {"detail": 58, "null": 12, "country_price": 12, "country_count": 12,
                      "other": 12, "note": 12}


def test_country(cleaned):
    rows = cleaned.country.orderBy("year").collect()
    assert len(rows) == 12 and {r.locality for r in rows} == {stages.COUNTRY_NAME}
    assert rows[0].n_offers == 1150 and rows[0].average_price_nominal_euros == 600000.0
    assert cleaned.country.columns == ["locality", "average_price_nominal_euros",
                                       "average_price_m2_nominal_euros", "year", "n_offers"]


def test_coverage(spark, cleaned):
    pages = spark.createDataFrame(commune_pages(), "page_id long, html string")
    tables = lambda i: html.html_tables(pages.filter(F.col("page_id") == i))
    current = stages.entity_list(tables(1), 1, 2, "Name", occurrence=2)
    former = stages.entity_list(tables(2), 2, 1, "Name")
    raw = stages.communes(current, former, harmonise=False)
    missing_raw = [r.locality for r in stages.coverage(cleaned.panel, raw).collect()]
    assert sorted(missing_raw) == ["Luxembourg", "Pétange"]
    clean = stages.communes(current, former)
    assert sorted(r.commune for r in clean.collect()) == sorted(
        ["Clémency", "Erpeldange", "Esch-sur-Alzette", "Kaerjeng", "Luxembourg", "Mamer",
         "Pétange", "Schengen"])
    assert stages.coverage(cleaned.panel, clean).count() == 0


def test_index_and_series(spark, cleaned):
    indexed, long, versus = stages.index_and_series(cleaned.panel, cleaned.country)
    got = {(r.locality, r.year): (r.pl, r.pl_m2) for r in indexed.collect()}
    assert got[("Esch-sur-Alzette", 2010)] == (100.0, 100.0)
    assert abs(got[("Mamer", 2011)][0] - 105.0) < 1e-9
    assert got[("Schengen", 2015)] == (None, None)          # no base-year row
    assert got[("Pétange", 2012)][0] is None and got[("Pétange", 2012)][1] is not None
    assert long.count() == 4 * 12 * 2 - 2 * 2               # Schengen has 10 years
    assert {r.series for r in long.collect()} == {"pl", "pl_m2"}
    v = {(r.locality, r.year): r.gap for r in versus.collect()}
    assert abs(v[("Esch-sur-Alzette", 2013)]) < 1e-9        # same growth as the nation
    assert versus.filter(F.col("locality") == "Wincrange").count() == 0


def test_run_writes_all_outputs(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "deliveries.xlsx")
    write_xlsx(path, delivery_sheets())
    raw = workbook.sheet_frame(workbook.read_workbooks(spark, path, skip_rows=6, header=HEADERS), HEADERS)
    out = stages.run(spark, raw, os.path.join(tmpdir_path, "out"))
    assert spark.read.parquet(out["panel"]).count() == 58
    assert spark.read.parquet(out["country"]).count() == 12
    idx = spark.read.parquet(out["indexed"])
    assert idx.filter("year = 2010 AND locality = 'Mamer'").first().pl == 100.0
    assert {"locality=Mamer", "locality=Schengen"} <= set(os.listdir(out["series"]))
    assert spark.read.parquet(out["versus"]).count() == 4 * 12 - 2


def test_replace_chars(spark):
    from pinax.functions.text import replace_chars
    df = spark.createDataFrame([("Pétange",), ("Erpeldange-sur-Sûre",), ("Käerjeng",)], "v string")
    m = {"é": "e", "û": "u", "ä": "a"}
    assert [r.x for r in df.select(replace_chars("v", m).alias("x")).collect()] == \
        ["Petange", "Erpeldange-sur-Sure", "Kaerjeng"]


def test_cli_run_and_coverage(spark, tmpdir_path):
    from pinax import cli
    wb = os.path.join(tmpdir_path, "wb")
    os.makedirs(wb)
    write_xlsx(os.path.join(wb, "deliveries.xlsx"), delivery_sheets())
    out = os.path.join(tmpdir_path, "out")
    assert cli.main(["run", "--workbooks", wb, "--out", out]) == 0
    assert spark.read.parquet(f"{out}/panel").count() == 58
    pages = os.path.join(tmpdir_path, "pages")
    spark.createDataFrame(commune_pages(), "page_id long, html string").write.parquet(pages)
    miss = os.path.join(tmpdir_path, "missing")
    assert cli.main(["coverage", "--panel", f"{out}/panel", "--pages", pages, "--out", miss]) == 0
    assert spark.read.parquet(miss).count() == 0


def test_run_is_idempotent(spark, tmpdir_path):
    """A re-run after a failure overwrites the outputs instead of adding to them."""
    path = os.path.join(tmpdir_path, "deliveries.xlsx")
    write_xlsx(path, delivery_sheets())
    raw = workbook.sheet_frame(workbook.read_workbooks(spark, path, skip_rows=6, header=HEADERS), HEADERS)
    out_dir = os.path.join(tmpdir_path, "out")
    first = stages.run(spark, raw, out_dir)
    counts = {k: spark.read.parquet(p).count() for k, p in first.items()}
    second = stages.run(spark, raw, out_dir)
    assert {k: spark.read.parquet(p).count() for k, p in second.items()} == counts


def _raw(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in [*HEADERS, "sheet"]))


NATION = [("Moyenne nationale", None, "600000", "5000", "2022.rev2"), ("Total d'offres", "19,278", None, None, "2022.rev2"),
          ("Source : x", None, None, None, "2022.rev2")]


def test_numbers_and_years_are_read_leniently(spark):
    rows = [("Mamer", "19278.0", "1,000.5", "1", "2022.rev2"), ("Esch", "1.9278E4", "*", "2", "2022.rev2"),
            ("Schengen", "19,278", "3", "x", "2022.rev2"), *NATION]
    c = stages.clean_deliveries(_raw(spark, rows), thousands_sep=",")
    got = {r.locality: r for r in c.panel.collect()}
    assert {r.n_offers for r in got.values()} == {19278} and {r.year for r in got.values()} == {2022}
    assert got["Mamer"].average_price_nominal_euros == 1000.5 and got["Esch"].average_price_nominal_euros is None
    assert c.country.first().n_offers == 19278
    lost = stages.data_checks(c, thousands_sep=",")["casts"].collect()
    assert [(r.locality, list(r["columns"])) for r in lost] == [("Schengen", ["average_price_m2_nominal_euros"])]


def test_a_sheet_without_a_year_fails(spark):
    with pytest.raises(Exception, match="no year in sheet name"):
        stages.clean_deliveries(_raw(spark, [("Mamer", "1", "2", "3", "sheet 1")])).panel.collect()


def test_two_national_rows_of_a_year_fail(spark):
    with pytest.raises(Exception, match="more than one national row"):
        stages.clean_deliveries(_raw(spark, [*NATION, NATION[0]])).country.collect()


def test_run_reports_what_a_delivery_changed(spark, tmpdir_path):
    """A changed old value, a lost commune and a bad cast are reported, and stop a strict run."""
    old = [("Mamer", "10", "1", "1", "2021"), ("Esch", "5", "2", "2", "2021"),
           ("Moyenne nationale", None, "2", "2", "2021"), ("Total d'offres", "15", None, None, "2021")]
    new = [("Mamer", "10", "1.5", "bad", "2021"), *old[2:]]
    first = stages.run(spark, _raw(spark, old), f"{tmpdir_path}/old", selected=["Mamer"], base=2021)
    assert spark.read.parquet(first["checks/casts"]).count() == 0
    previous = spark.read.parquet(first["panel"])
    dim = spark.createDataFrame([("Esch",)], "commune string")
    out = stages.run(spark, _raw(spark, new), f"{tmpdir_path}/new", selected=["Mamer"], base=2021, previous=previous,
                     dim=dim)
    read = lambda n: spark.read.parquet(out[f"checks/{n}"]).collect()
    assert {(r.locality, r.kind) for r in read("revisions")} == {("Mamer", "changed"), ("Esch", "removed")}
    assert [(r.locality, list(r["columns"])) for r in read("casts")] == [("Mamer", ["average_price_m2_nominal_euros"])]
    assert [r.year for r in read("totals")] == [2021] and [r.locality for r in read("coverage")] == ["Mamer"]
    assert read("nulls")[0].average_price_m2_nominal_euros_nulls == 1 and read("fingerprint")[0].n_rows == 1
    with pytest.raises(stages.CheckFailed, match="casts, totals, revisions, coverage"):
        stages.run(spark, _raw(spark, new), f"{tmpdir_path}/strict", selected=["Mamer"], base=2021,
                   previous=previous, dim=dim, fail_on=stages.MUST_BE_EMPTY)
    assert os.path.exists(f"{tmpdir_path}/strict/checks/casts") and not os.path.exists(f"{tmpdir_path}/strict/panel")


def test_run_leaves_no_staged_files(spark, tmpdir_path):
    from pinax.session import checkpoint_dir

    top = f"{checkpoint_dir(spark).removeprefix('file:')}/pinax-stage"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    stages.run(spark, _raw(spark, [("Mamer", "10", "1", "1", "2021"), *NATION]), tmpdir_path + "/o", base=2021)
    assert {x for x in set(os.listdir(top)) - before if x.startswith("classified")} == set()
