import gzip
import os
import random

from pyspark.sql import functions as F

from pinax.sources import files, html, workbook
from tests.fixtures import (COUNTRY_CSV, COUNTRY_SCHEMA, HEADERS, commune_pages, delivery_sheets,
                            write_xlsx)


def test_csv_gzip_and_latin1(spark, tmpdir_path):
    plain = os.path.join(tmpdir_path, "country.csv")
    with open(plain, "w") as f:
        f.write(COUNTRY_CSV)
    gz = os.path.join(tmpdir_path, "country.csv.gz")
    with gzip.open(gz, "wt") as f:
        f.write(COUNTRY_CSV)
    a = files.read_csv(spark, plain, COUNTRY_SCHEMA)
    b = files.read_csv(spark, gz, COUNTRY_SCHEMA, partitions=3)
    assert a.count() == b.count() == 12
    assert a.schema.simpleString() == b.schema.simpleString()
    assert sorted(a.collect()) == sorted(b.collect())
    lat = os.path.join(tmpdir_path, "latin1.csv")
    with open(lat, "wb") as f:
        f.write("commune\nPétange\nErpeldange-sur-Sûre\nKäerjeng\n".encode("latin-1"))
    got = [r.commune for r in files.read_csv(spark, lat, "commune string", encoding="ISO-8859-1").collect()]
    assert got == ["Pétange", "Erpeldange-sur-Sûre", "Käerjeng"]


def test_read_tagged_and_write(spark, tmpdir_path):
    for y in (2010, 2011):
        spark.range(3).withColumn("v", F.lit(y)).write.parquet(os.path.join(tmpdir_path, f"in/{y}.parquet"))
    df = files.read_tagged(spark, [os.path.join(tmpdir_path, f"in/{y}.parquet") for y in (2010, 2011)],
                           tag_col="year", pattern=r"/(\d{4})\.parquet/")
    got = sorted((r.year, r.v) for r in df.select("year", "v").distinct().collect())
    assert got == [("2010", 2010), ("2011", 2011)]
    out = os.path.join(tmpdir_path, "series")
    files.write_series(df.select("year", "id", "v"), out, "year")
    back = spark.read.parquet(out)
    assert back.count() == 6
    assert {"year=2010", "year=2011"} <= set(os.listdir(out))
    staged = files.stage(df.select("id", "v"), "unit")
    assert staged.count() == 6


def _same_layout(d, name, rows):
    write_xlsx(os.path.join(d, name), {"2020": [[]] * 2 + rows})


def test_workbook_rows_and_columns_beyond_the_header(spark, tmpdir_path):
    """The whole header counts, and a filled cell beyond it is an error, not a lost column."""
    for name, rows, error in (("a", [["A", "B"], ["1", "2"]], None),
                              ("b", [["A", "B", "EXTRA"], ["1", "2", "3"]], "header"),
                              ("c", [["A", "B"], ["1", "2", "3"]], "has 3 cells"),
                              ("d", [["B", "A"], ["1", "2"]], "header"),
                              ("e", [["A", "B", None], ["1", "2", None]], None)):
        d = os.path.join(tmpdir_path, name)
        os.makedirs(d)
        _same_layout(d, "x.xlsx", rows)
        got = workbook.read_workbooks(spark, d, skip_rows=2, header=["A", "B"]).collect()
        if error:
            assert len(got) == 1 and error in got[0].error
        else:
            assert [(r.error, r.sheet) for r in got] == [(None, "2020")]


def test_csv_round_trip_over_several_part_files(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"é{i}", i / 2) for i in range(30)], "k long, v string, x double").repartition(4)
    path = os.path.join(tmpdir_path, "csv")
    files.write_table(df, path, fmt="csv")
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 4
    assert sorted(files.read_csv(spark, path, df.schema).collect()) == sorted(df.collect())


def test_csv_with_swapped_columns_or_bad_cells_fails(spark, tmpdir_path):
    import pytest as _pytest
    for text in ("v,k\n1,x\n", "k,v\nx,notanumber\n", "k,v,w\nx,1,2\n"):
        p = os.path.join(tmpdir_path, "f.csv")
        with open(p, "w") as f:
            f.write(text)
        with _pytest.raises(Exception):
            files.read_csv(spark, p, "k string, v int").collect()


def test_sheet_exports_with_more_columns_fail(spark, tmpdir_path):
    import pytest as _pytest
    for i, text in enumerate(("A,B,EXTRA\n1,2,3\n", "A,B\n1,2,3\n")):
        d = os.path.join(tmpdir_path, f"x{i}")
        os.makedirs(d)
        with open(os.path.join(d, "2020.csv"), "w") as f:
            f.write(text)
        with _pytest.raises(Exception, match="header differs|more cells"):
            files.read_sheet_exports(spark, d, ["A", "B"]).collect()


def test_tagged_inputs_must_have_one_schema(spark, tmpdir_path):
    import pytest as _pytest
    a, b = os.path.join(tmpdir_path, "a"), os.path.join(tmpdir_path, "b")
    spark.range(2).withColumn("v", F.lit(1)).write.parquet(a)
    spark.range(2).withColumn("w", F.lit(1)).write.parquet(b)
    with _pytest.raises(ValueError, match="has columns"):
        files.read_tagged(spark, [a, b])


def test_partitioned_table_has_few_files(spark, tmpdir_path):
    df = spark.range(4000).select("id", (F.col("id") % 5).alias("y")).repartition(8)
    path = os.path.join(tmpdir_path, "t")
    files.write_table(df, path, partition_by=["y"])
    assert spark.read.parquet(path).count() == 4000
    for d in os.listdir(path):
        if d.startswith("y="):
            assert len([f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")]) == 1


def test_html_tables_and_links(spark):
    pages = spark.createDataFrame(commune_pages(), "page_id long, html string")
    tables = html.html_tables(pages)
    cells = html.html_cells(tables)
    t = {(r.page_id, r.table_idx, r.row_idx): (r.is_header, list(r.cells)) for r in cells.collect()}
    assert t[(1, 1, 0)] == (True, ["Name", "Name", "Canton"])      # colspan repeated
    assert t[(1, 1, 1)] == (True, ["Name", "Name", "Canton"])
    assert t[(1, 1, 3)][1] == ["x", "Erpeldange-sur-Sûre †", "Diekirch"]
    assert max(k[1] for k in t if k[0] == 2) == 2
    rows = html.table_rows(tables, 1, header_rows=2)
    col = [r.Name for r in html.column(rows, "Name", occurrence=2).filter("page_id = 1").collect()]
    assert "Luxembourg City" in col and len(col) == 7
    links_html = '<ul><li><a href="/a?x=1&amp;y=2">A &amp; B</a></li><li>no link</li></ul><a href="/out">o</a>'
    open_li = '<ol><li><a href="/1">one<li><a href="/2">two</ol><p><a href="/no">x</a></p>'
    lp = spark.createDataFrame([(9, links_html), (10, None), (11, open_li)], "page_id long, html string")
    got = [(r.page_id, r.pos, r.href, r.text) for r in html.list_links(lp).orderBy("page_id", "pos").collect()]
    assert got == [(9, 1, "/a?x=1&y=2", "A & B"), (11, 1, "/1", "one"), (11, 2, "/2", "two")]


def test_rowspan_cells(spark):
    page = ('<table><tr><th>A</th><th>B</th></tr><tr><td rowspan="2">x</td><td>1</td></tr>'
            '<tr><td>2</td></tr></table>')
    cells = html.html_cells(html.html_tables(spark.createDataFrame([(1, page)], "page_id long, html string")))
    got = [list(r.cells) for r in cells.orderBy("row_idx").collect()]
    assert got == [["A", "B"], ["x", "1"], ["x", "2"]]


def test_read_workbooks_via_binary_files(spark, tmpdir_path):
    import pytest as _pytest
    d = os.path.join(tmpdir_path, "wb")
    os.makedirs(d)
    write_xlsx(os.path.join(d, "a.xlsx"), delivery_sheets(range(2010, 2016)))
    write_xlsx(os.path.join(d, "b.xlsx"), delivery_sheets(range(2016, 2022)))
    raw = workbook.read_workbooks(spark, d)
    assert raw.count() == 2 * 13 + 10 * 14          # stored rows only: 3 preamble, header, 9-10 data
    rows = workbook.read_workbooks(spark, d, skip_rows=6, header=HEADERS)
    wide = workbook.sheet_frame(rows, HEADERS)
    assert wide.columns == [*HEADERS, "sheet"]
    got = wide.filter("sheet = '2010'").collect()
    assert wide.count() == 10 * 10 + 2 * 9            # Schengen starts in 2012
    assert got[0]["Commune"] == "  Esch-sur-Alzette\u00a0" and got[0]["Nombre d'offres"] == "120"
    assert float(got[0]["Prix moyen annoncé en € courant"]) == 400000.0
    # a broken file, a drifted header and a shifted header: error rows, no partial rows
    with open(os.path.join(d, "broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    shifted = {k: [[]] + v for k, v in delivery_sheets(range(2030, 2031)).items()}
    write_xlsx(os.path.join(d, "shifted.xlsx"), shifted)
    rows = workbook.read_workbooks(spark, d, skip_rows=6, header=HEADERS)
    errs = rows.filter("error IS NOT NULL")
    assert errs.count() == 2 and rows.filter("path LIKE '%shifted%' AND error IS NULL").count() == 0
    assert workbook.sheet_frame(rows, HEADERS, strict=False).count() == wide.count()
    with _pytest.raises(Exception, match="could not be read"):
        workbook.sheet_frame(rows, HEADERS).collect()
    drift = workbook.read_workbooks(spark, os.path.join(d, "a.xlsx"), skip_rows=6,
                                    header=["Commune", "Offres", "x", "y"])
    assert drift.filter("error LIKE '%header%'").count() == 1


def test_read_sheet_exports_skips_preamble(spark, tmpdir_path):
    import csv
    d = os.path.join(tmpdir_path, "exports")
    os.makedirs(d)
    sheets = delivery_sheets(range(2010, 2013))
    for name, rows in sheets.items():
        with open(os.path.join(d, f"{name}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n")
            for r in rows:
                w.writerow(["" if v is None else v for v in r])
    df = files.read_sheet_exports(spark, d, HEADERS, skip_rows=6)
    assert df.columns == [*HEADERS, "sheet"]
    assert df.count() == 9 + 9 + 10
    first = df.filter("sheet = '2010'").first()
    assert first["Commune"] == "  Esch-sur-Alzette\u00a0" and first["Nombre d'offres"] == "120"
    import pytest as _pytest
    with _pytest.raises(Exception, match="header differs"):
        files.read_sheet_exports(spark, d, HEADERS, skip_rows=5).collect()


def test_sheet_exports_bom_quotes_and_short_files(spark, tmpdir_path):
    import pytest as _pytest
    d = os.path.join(tmpdir_path, "bom")
    os.makedirs(d)
    with open(os.path.join(d, "2020.csv"), "w", encoding="utf-8-sig") as f:
        f.write('"Commune","Nombre d\'offres"\nMamer,40\n')
    df = files.read_sheet_exports(spark, d, ["Commune", "Nombre d'offres"])
    assert [tuple(r) for r in df.collect()] == [("Mamer", "40", "2020")]
    short = os.path.join(tmpdir_path, "short")
    os.makedirs(short)
    with open(os.path.join(short, "2021.csv"), "w") as f:
        f.write("Observatoire")
    with _pytest.raises(Exception, match="no header"):
        files.read_sheet_exports(spark, short, ["Commune", "Nombre d'offres"], skip_rows=3).collect()
    with open(os.path.join(short, "2021.csv"), "w") as f:
        f.write("")
    # Spark's file listing skips 0-byte files: an empty export adds no rows
    assert files.read_sheet_exports(spark, short, ["Commune", "Nombre d'offres"]).count() == 0


def test_published_index_series_gzip_pivot(spark, tmpdir_path):
    """a published house-price index (geo, TIME_PERIOD, OBS_VALUE) as gzip CSV,
    read under a schema and laid side by side per year (A6, J3)."""
    from pinax.operators import series
    p = os.path.join(tmpdir_path, "hpi.csv.gz")
    rows = ["geo,TIME_PERIOD,OBS_VALUE", "LU,2020,190.31", "LU,2021,214.81", "EU27_2020,2020,127.12",
            "EU27_2020,2021,138.92", "DE,2021,160.5"]
    with gzip.open(p, "wt") as f:
        f.write("\n".join(rows) + "\n")
    hpi = files.read_csv(spark, p, "geo string, TIME_PERIOD bigint, OBS_VALUE double")
    wide = series.pivot_wide(hpi, "TIME_PERIOD", "geo", "OBS_VALUE", ["LU", "EU27_2020"])
    got = {r.TIME_PERIOD: (r.LU, r.EU27_2020) for r in wide.collect()}
    assert got == {2020: (190.31, 127.12), 2021: (214.81, 138.92)}


def test_file_tag_strips_all_or_last_extension(spark, tmpdir_path):
    from pyspark.sql import functions as F
    d = os.path.join(tmpdir_path, "tags")
    os.makedirs(d)
    for n in ("2022.rev2.csv", "2021.csv", "plain"):
        with open(os.path.join(d, n), "w") as f:
            f.write("a\n1\n")
    df = spark.read.option("header", True).csv(d)
    got = {(r.a, r.b) for r in df.select(files.file_tag().alias("a"),
                                         files.file_tag(strip="last").alias("b")).collect()}
    assert got == {("2022", "2022.rev2"), ("2021", "2021"), ("plain", "plain")}


def _numbered(spark, folder, **options):
    return {(r.name, r.line_no): r.line for r in files.numbered_lines(spark, folder, **options).collect()}


def test_lines_of_many_splits_are_numbered(spark, tmpdir_path):
    r = random.Random(2)
    want = {}
    for name, n, end in (("a.txt", 4000, "\n"), ("b.txt", 1, ""), ("c.txt", 700, "\r\n"), ("sub/d.txt", 90, "\n")):
        rows = ["x" * r.randint(0, 60) + str(i) for i in range(n)]
        path = os.path.join(tmpdir_path, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as f:
            f.write("".join(x + end for x in rows))
        want |= {(os.path.basename(name), i): x for i, x in enumerate(rows, 1)}
    with gzip.open(os.path.join(tmpdir_path, "e.txt.gz"), "wt") as f:
        f.write("".join(f"{i}\n" for i in range(500)))
    want |= {("e.txt.gz", i + 1): str(i) for i in range(500)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = files.numbered_lines(spark, tmpdir_path)
        assert lines.rdd.getNumPartitions() > 1 and spark.read.text(tmpdir_path).rdd.getNumPartitions() > 20
        assert _numbered(spark, tmpdir_path) == want
        # A large sheet with a preamble is read by many tasks, as one row after the other.
        path = os.path.join(tmpdir_path, "sheet.csv")
        with open(path, "w", encoding="latin-1") as f:
            f.write("note\n\nCommune,n\n" + "".join(f"Pétange {i},{i}\n" for i in range(3000)))
        got = files.read_sheet_exports(spark, path, ["Commune", "n"], skip_rows=2, encoding="ISO-8859-1")
        assert sorted(int(r.n) for r in got.collect()) == list(range(3000))
        assert {r.Commune == f"Pétange {r.n}" for r in got.collect()} == {True}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quoted_line_breaks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "s.csv")
    with open(path, "w") as f:
        f.write('note\nA,B\n"two\nlines",1\nplain,2\n"a ""quoted"" word",3\n"x\n\ny, z\n",4\nlast,5\n')
    got = files.read_sheet_exports(spark, path, ["A", "B"], skip_rows=1, line_breaks=True).collect()
    assert sorted((r.B, r.A) for r in got) == [("1", "two\nlines"), ("2", "plain"), ("3", 'a ""quoted"" word'.replace('""', '"')),
                                               ("4", "x\n\ny, z\n"), ("5", "last")]


def test_bad_rows_are_quarantined(spark, tmpdir_path):
    for name, body in (("one.csv", "id,x\n1,1.5\nb,2\n3,4,5\n4\n\n5,\n6,7"), ("two.csv", "x,id\n8,9.5\n")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    checked = files.read_csv_checked(spark, tmpdir_path, "id int, x double", glob="*.csv")
    good, bad = files.quarantine(checked, os.path.join(tmpdir_path, "out"))
    assert sorted((r.id, r.x) for r in good.collect()) == [(1, 1.5), (5, None), (6, 7.0), (8, 9.5)]
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in bad.collect()) == [
        ("one.csv", 3, "b,2"), ("one.csv", 4, "3,4,5"), ("one.csv", 5, "4"), ("two.csv", 1, "x,id")]


def test_sheets_of_a_workbook_are_tasks(spark, tmpdir_path, monkeypatch):
    """Twelve sheets are decoded by several tasks, in batches, and no list of a whole file is made."""
    sheets = {str(2000 + i): [["A", "B"], *[[f"é{i}", str(k)] for k in range(300)]] for i in range(12)}
    path = os.path.join(tmpdir_path, "twelve.xlsx")
    write_xlsx(path, sheets)
    monkeypatch.setattr(workbook, "BATCH_ROWS", 70)
    rows = workbook.read_workbooks(spark, path, skip_rows=0, header=["A", "B"])
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 3600 and {r.sheet for r in got} == set(sheets)
    assert len({r.task for r in got}) > 3
    packed = list(workbook.packed_sheets(open(path, "rb").read(), None))
    assert [n for n, _ in packed] == sorted(sheets)
    for task in (workbook._decoded(0, ["A", "B"]),):
        import pyarrow as pa
        rb = pa.RecordBatch.from_pydict({"path": ["p"], "no": [0], "sheet": ["2000"], "packed": [packed[0][1]], "error": [None]})
        assert [b.num_rows for b in task(iter([rb]))] == [70, 70, 70, 70, 20]


def test_layouts_of_many_files(spark, tmpdir_path):
    from pinax.operators import checks

    write_xlsx(os.path.join(tmpdir_path, "a.xlsx"), {"1": [["x"], ["A", "B"], ["1", "2"]], "2": [["x"], ["B", "A"]]})
    write_xlsx(os.path.join(tmpdir_path, "b.xlsx"), {"1": [["x"], ["A", "C"]], "2": [["x"]]})
    with open(os.path.join(tmpdir_path, "broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    for name, line in (("a.csv", 'A,"B"'), ("b.csv", 'A,"B, ""b""",'), ("c.csv", "A,B")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(f"note\n{line}\n1,2\n")
    sheets = workbook.sheet_headers(spark, tmpdir_path, skip_rows=1)
    found = checks.schema_versions(sheets, ["A", "B"])
    got = {None if r["columns"] is None else tuple(r["columns"]): (r.n_parts, r.n_files, r.missing, r.unexpected, r.moved)
           for r in found.collect()}
    assert got == {("A", "B"): (1, 1, [], [], False), ("B", "A"): (1, 1, [], [], True),
                   ("A", "C"): (1, 1, ["B"], ["C"], False), None: (2, 2, ["A", "B"], [], False)}
    assert checks.drifted(found, ["A", "B"]).count() == 3
    lines = files.file_headers(spark, tmpdir_path, skip_rows=1, glob="*.csv")
    assert sorted(map(tuple, (r["columns"] for r in lines.collect()))) == [("A", "B"), ("A", "B"), ("A", 'B, "b"', "")]


def _links(spark, page):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    return [(r.pos, r.href, r.text) for r in html.list_links(df).orderBy("pos").collect()]


def test_links_anywhere_in_a_list_item(spark):
    page = """<ul><li><b><a href="/1">one</a></b><li>See <a class=x href='/2'>two <i>b</i></a> and <a href=/3>three</a>
      <!-- <li><a href="/no">no</a> --><li class="a>b"><a data-href="/x" title="t" href="/4?a=1&amp;b=2">4 &amp;lt; 5</a></li>
      <li><a name="here">no address</a><li>none</ul><a href="/out">out</a>
      <script>var x = "<li><a href='/js'>";</script>
      <ol><li><a href="/5">P&eacute;tange &#233;&#xE9; &euro; &unknown; & &amp</a><ul><li><A HREF="/6">six</a></ul></ol><p><a href="/no">x"""
    assert _links(spark, page) == [
        (1, "/1", "one"), (2, "/2", "two b"), (3, "/3", "three"), (4, "/4?a=1&b=2", "4 &lt; 5"),
        (5, "/5", "Pétange éé € &unknown; & &amp"), (6, "/6", "six")]
    assert _links(spark, None) == _links(spark, "") == _links(spark, "<li><a href=") == []
    long = "<ul><li " + "x=1 " * 20000 + ">" + "<a href=/a " + "y='2' " * 20000 + ">t</a>" + "z" * 300000 + "</ul>"
    assert _links(spark, long) == [(1, "/a", "t")]


def test_hot_pages_are_split_and_parsed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(html, "BATCH_CHARS", 500)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("cust"))
    cells = F.concat(F.lit("<tr><td>"), F.col("id").cast("string"), F.lit("</td></tr>"))
    pages = html.subpages(rows, "cust", "id", cells, "<table><tr><th>Key</th></tr>", "</table>", rows_per_page=100)
    of_hot = pages.filter("page_id = 7").collect()
    assert len(of_hot) > 8 and max(p.html.count("<td>") for p in of_hot) < 200
    got = html.columns(html.table_rows(html.html_tables(pages), 0), {"key": ("Key", 1)})
    assert sorted((r.page_id, int(r.key)) for r in got.collect()) == sorted((r.cust, r.id) for r in rows.collect())


def test_clustered_series_touch_few_files(spark, tmpdir_path):
    """Thousands of entities in a few files, and one of them is read from one or two."""
    rows = spark.range(30_000).select((F.col("id") % 3000).alias("e"), (F.col("id") / 3000).cast("int").alias("y"), "id")
    path = os.path.join(tmpdir_path, "series")
    files.write_series_clustered(rows, path, "e", "y", files=12)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 12
    one = files.read_series(spark, path, "e", [1234])
    assert one.count() == 10 and one.select(F.input_file_name()).distinct().count() <= 2
    assert "In(e" in one._jdf.queryExecution().executedPlan().toString() or "EqualTo(e" in \
        one._jdf.queryExecution().executedPlan().toString()
    assert sorted(files.read_series(spark, path, "e").collect()) == sorted(rows.collect())
