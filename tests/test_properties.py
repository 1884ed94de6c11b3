"""Property tests: Spark row rules against their plain-Python definitions."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pinax.functions import text as T
from pinax.functions.names import clean_name
from pinax.operators import checks, route

# Letters and marks of a few scripts, digits, punctuation, symbols and many
# kinds of white space (incl. no-break and ideographic spaces).
ALPHABET = st.one_of(
    st.characters(min_codepoint=0x20, max_codepoint=0x7E),
    st.sampled_from("éèêëàâäîïôöûüçÉÈÄÖÜßñÑøØåÅœŒ€£²³µ°§«»¿¡"),
    st.sampled_from("αβγΔΩжЖщЯ"),
    st.sampled_from("\t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2009\u202f\u3000\x1c"),
)
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=60)
SETTINGS = settings(max_examples=int(os.environ.get("PROP_EXAMPLES", "6")), deadline=None,
                    suppress_health_check=[HealthCheck.too_slow])


@SETTINGS
@given(TEXTS)
def test_name_rule_row_equals_metadata_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", T.name_rule("t").alias("k")).collect()}
    assert got == {i: clean_name(t) for i, t in enumerate(texts)}


@SETTINGS
@given(TEXTS)
def test_strip_equals_white_space_strip(spark, texts):
    ws = T._WS_CHARS
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", T.strip_ws("t").alias("s")).collect()}
    assert got == {i: t.strip(ws) for i, t in enumerate(texts)}


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(
    ["Source : x", "Moyenne nationale", "Total d'offres", "Commune", "Mamer", "offres", "nationale Source"])),
    min_size=1, max_size=50))
def test_row_classes_partition_the_rows(spark, cells):
    rules = [("note", "Source"), ("country_price", "nationale"), ("country_count", "Total d.offres"),
             ("other", "offres|Commune")]
    df = spark.createDataFrame([(c,) for c in cells], "locality string")
    r = route.route(df, "locality", rules)
    counts = {x.row_class: x["count"] for x in r.groupBy("row_class").count().collect()}
    assert sum(counts.values()) == len(cells)
    branches = sum(route.branch(r, k).count() for k in counts)
    assert branches == len(cells)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(2000, 2004),
                          st.one_of(st.none(), st.floats(0.5, 1e6, allow_nan=False))),
                min_size=1, max_size=40, unique_by=lambda t: (t[0], t[1])))
def test_fingerprint_ignores_partitioning(spark, rows):
    df = spark.createDataFrame(rows, "k int, y int, v double")
    a = checks.fingerprint(df).first()
    b = checks.fingerprint(df.repartition(5, F.col("y"))).first()
    assert a == b and a.n_rows == len(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.integers(min_value=1, max_value=16), st.sampled_from(["join", "window"]))
def test_index_ignores_partitioning(spark, n, how):
    from pinax.operators import index
    from pinax.plans.panels import nation_year_prices
    p = nation_year_prices(spark, "/root/testdata/sf0.001").select("n_name", "year", "price")
    key = lambda r: (r.n_name, r.year)
    a = sorted(index.price_index(p, ["n_name"], "year", 1995, ["price"], how=how).collect(), key=key)
    b = sorted(index.price_index(p.repartition(n), ["n_name"], "year", 1995, ["price"], how=how).collect(),
               key=key)
    assert a == b
