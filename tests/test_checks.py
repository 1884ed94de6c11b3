import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pinax.operators import checks, columns, entities
from pinax.operators.joins import join_lookup


def test_revisions_kinds(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, None, "c"), (4, 4.0, "d")],
                                "k long, v double, s string")
    new = spark.createDataFrame([(1, 1.0, "a"), (2, 2.5, "b"), (3, None, "c"), (5, 5.0, "e"),
                                 (6, 1.0, "x"), (6, 1.0, "x")], "k long, v double, s string")
    got = {r.k: r.kind for r in checks.revisions(old, new, ["k"], ["v", "s"]).collect()}
    assert got == {2: "changed", 4: "removed", 5: "added", 6: "duplicate"}


def test_totals_match(spark):
    detail = spark.createDataFrame([(2010, 5), (2010, 6), (2011, 1), (2012, 3)], "year int, n long")
    totals = spark.createDataFrame([(2010, 11), (2011, 2), (2013, 9)], "year int, n long")
    got = {r.year: r.ok for r in checks.totals_match(detail, totals, "year", "n", "n").collect()}
    assert got == {2010: True, 2011: False, 2012: False, 2013: False}


def test_churn_flags(spark):
    df = spark.createDataFrame([("a", 2010), ("a", 2012), ("b", 2011), ("c", 2010), ("c", 2011)],
                               "k string, y int")
    got = {r.k: (r.appeared, r.vanished) for r in checks.churn(df, "k", "y").collect()}
    assert got == {"a": (False, False), "b": (True, True), "c": (False, True)}


def test_fingerprint_is_order_and_partition_free(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    a = checks.fingerprint(df).first()
    b = checks.fingerprint(df.repartition(7)).first()
    c = checks.fingerprint(df.orderBy(F.desc("o_orderkey")).coalesce(3)).first()
    assert a == b == c
    d = checks.fingerprint(df.withColumn("o_totalprice", F.col("o_totalprice") + 0.01)).first()
    assert d.hash_sum != a.hash_sum and d.n_rows == a.n_rows


def test_duplicate_keys_and_null_report(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 1, "x"), (2, 1, "y")], "a int, b int, c string")
    assert [(r.a, r.b, r.n) for r in checks.duplicate_keys(df, ["a", "b"]).collect()] == [(1, 1, 2)]
    r = checks.null_report(df).first()
    assert (r.n_rows, r.a_nulls, r.c_nulls) == (3, 0, 1)
    assert checks.null_rows(df, "c").count() == 1


def test_cast_failures_and_schema_drift(spark):
    df = spark.createDataFrame([("1", "x"), ("*", "2"), (None, "3"), ("4", "4")], "a string, b string")
    r = checks.cast_failures(df, ["a", "b"], tolerance=0.4).first()
    assert (r.a_fail_share, r.b_fail_share, r.ok) == (1 / 3, 0.25, True)
    exp = StructType.fromDDL("a string, b double, c int")
    assert checks.schema_drift(exp, df) == [("b", "double", "string"), ("c", "int", "missing")]


def test_stack_checks_schema(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert entities.stack([a, b]).collect()[1].k == 2
    with pytest.raises(TypeError):
        entities.stack([a, spark.createDataFrame([("1", "x")], "k string, v string")])
    with pytest.raises(ValueError):
        entities.stack([a, spark.createDataFrame([(1,)], "k int")])


def test_missing_from_handles_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "loc string")
    dim = spark.createDataFrame([("a",), (None,)], "commune string")
    assert [r.loc for r in entities.missing_from(df, "loc", dim, "commune").collect()] == ["b"]
    full = spark.createDataFrame([("a",), ("b",)], "commune string")
    assert entities.missing_from(df, "loc", full, "commune").count() == 0


def test_join_lookup_guards_uniqueness(spark):
    left = spark.createDataFrame([(2010, 1.0), (2011, 2.0)], "year int, p double")
    ok = spark.createDataFrame([(2010, 5), (2011, 6)], "year int, n long")
    assert join_lookup(left, ok, ["year"]).count() == 2
    bad = spark.createDataFrame([(2010, 5), (2010, 6)], "year int, n long")
    with pytest.raises(Exception, match="not unique"):
        join_lookup(left, bad, ["year"]).collect()
    with pytest.raises(Exception, match="not unique"):  # the guard is no value column that could be pruned
        join_lookup(left, bad, ["year"]).select("year", "p").collect()


def test_columns_helpers(spark):
    df = spark.createDataFrame([("x", "1", "2", 3)], "`Nom de la pièce` string, `Prix moyen` string, "
                                                     "`prix au m²` string, n int")
    c = columns.clean_columns(df)
    assert c.columns == ["nom_de_la_pice", "prix_moyen", "prix_au_m", "n"]
    with pytest.raises(KeyError):
        columns.rename_strict(c, {"missing": "x"})
    with pytest.raises(ValueError):
        columns.clean_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a  b` int"))
    r = columns.rename_strict(c, {"prix_moyen": "average_price"})
    assert columns.columns_matching(r, contains="price") == ["average_price"]
    assert columns.columns_matching(r, startswith="prix") == ["prix_au_m"]
    typed = columns.lenient_cast(r, ["average_price", "prix_au_m"])
    assert typed.first().average_price == 1.0
    k = columns.with_constant(typed, "nom_de_la_pice", "ALL")
    assert k.columns == typed.columns and k.first().nom_de_la_pice == "ALL"


def test_join_lookup_ignores_null_keys(spark):
    left = spark.createDataFrame([(2010, 1.0), (None, 2.0)], "year int, p double")
    right = spark.createDataFrame([(2010, 5), (None, 6), (None, 7)], "year int, n long")
    got = sorted((r.year, r.n) for r in join_lookup(left, right, ["year"]).collect())
    assert got == [(2010, 5)]


def test_master_detection(monkeypatch):
    from pinax import session
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell")
    assert session._master_configured()


def test_recode_report_shows_greedy_matches(spark):
    rules = [("P.*tange", "Pétange"), ("City", "Luxembourg")]
    df = spark.createDataFrame([("Petange",), ("Petange",), ("Paris et Petange",), ("Pétange",),
                                ("Luxembourg City",), ("Mamer",)], "commune string")
    got = {(r.before, r.after, r.n) for r in entities.recode_report(df, "commune", rules).collect()}
    assert got == {("Petange", "Pétange", 2), ("Paris et Petange", "Pétange", 1),
                   ("Luxembourg City", "Luxembourg", 1)}


def test_fingerprint_sees_a_moved_null_and_a_moved_border(spark):
    fp = lambda rows: checks.fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
    seen = [fp(r) for r in ([("x", None)], [(None, "x")], [("xy", "z")], [("x", "yz")], [("-", "")], [("", "-")])]
    assert len(set(seen)) == len(seen)
    assert fp([]).n_rows == 0 and fp([("x", None), ("x", None)]) != fp([("x", None)])
