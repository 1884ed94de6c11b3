"""

1. ``clean_deliveries``: raw sheet rows -> commune panel + country table.
2. ``entity_list`` / ``coverage``: tables scraped from pages -> entity
   dimension -> entities in the panel that the dimension lacks.
3. ``index_and_series``: panel -> base-year index -> selected series and the
   comparison with the national index.

Every step is ``DataFrame`` in, ``DataFrame`` out; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import drop_trailing_marker, lenient_double, replace_all
from ..operators import checks, columns, entities, index, lineage, route, series
from ..sources.files import drop_staged, stage, write_series, write_table
from ..sources.html import column, table_rows

# --- fixed values (must equal the reference's for the same results) ----------
# Column names after the name rule, and what they are renamed to.
RENAMES = {
    "commune": "locality",
    "nombre_doffres": "n_offers",
    "prix_moyen_annonc_en_courant": "average_price_nominal_euros",
    "prix_moyen_annonc_au_m_en_courant": "average_price_m2_nominal_euros",
}
# Spelling fixes applied to every locality, in this order.
LOCALITY_FIXES = [("Luxembourg.*", "Luxembourg"), ("P.*tange", "Pétange")]
# Row classes, first match wins: notes are dropped, the national average and
# the offer total feed the country table, other total or header rows are
# neither detail nor country rows.
ROW_RULES = [
    ("note", "Source"),
    ("country_price", "nationale"),
    ("country_count", "Total d.offres"),
    ("other", "offres|Commune"),
]
COUNTRY_NAME = "Grand-Duchy of Luxembourg"
# Spelling rules that map scraped commune names onto the panel's spelling.
ENTITY_RULES = [
    ("Cl.mency", "Clémency"),
    ("Erpeldange", "Erpeldange"),
    ("City", "Luxembourg"),
    ("K.*jeng", "Kaerjeng"),
    ("P.*tange", "Pétange"),
]
SELECTED = ["Luxembourg", "Esch-sur-Alzette", "Mamer", "Schengen", "Wincrange"]
BASE_YEAR = 2010
# -----------------------------------------------------------------------------

PRICE_MEASURES = {
    "average_price_nominal_euros": ("p0", "pl"),
    "average_price_m2_nominal_euros": ("p0_m2", "pl_m2"),
}
PANEL_COLUMNS = ["locality", "n_offers", "average_price_nominal_euros",
                 "average_price_m2_nominal_euros", "year"]


@dataclass
class Cleaned:
    classified: DataFrame   # every row with its row_class
    panel: DataFrame        # commune panel (detail rows)
    country: DataFrame      # one row per year


def classify(raw: DataFrame, sheet_col: str = "sheet", thousands_sep: str | None = None) -> DataFrame:
    """Names, renames, strip, lenient cast, spelling fixes and row classes.

    ``raw`` is a frame of string cells as read from the sheets (for instance
    ``workbook.sheet_frame``) with the sheet name in ``sheet_col``.  The year is
    the four digits that the sheet's name holds (``2022.rev2`` is of 2022); a
    name without them fails the job.  ``*_text`` columns keep the number cells as
    they came, for the cast report.
    """
    df = columns.clean_columns(raw.withColumnRenamed(sheet_col, "year"))
    df = columns.rename_strict(df, RENAMES)
    df = columns.strip_all(df)
    numbers = [*columns.columns_matching(df, contains="average"), "n_offers"]
    df = df.withColumns({f"{c}_text": F.col(c) for c in numbers})
    df = columns.lenient_cast(df, numbers, thousands_sep=thousands_sep)
    loc = F.col("locality")
    for pattern, value in LOCALITY_FIXES:
        loc = replace_all(loc, pattern, value)
    year = F.regexp_extract("year", r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    msg = F.concat(F.lit("no year in sheet name "), F.coalesce("year", F.lit("(null)")))
    df = df.withColumns({"locality": loc, "n_offers": F.col("n_offers").cast("bigint"),
                         "year": F.when(F.coalesce(year, F.lit("")) == "", F.raise_error(msg)).otherwise(year).cast("int")})
    return route.route(df, "locality", ROW_RULES, default="detail")


def split_classified(c: DataFrame, country_name: str = COUNTRY_NAME) -> Cleaned:
    """Commune panel and country table from classified rows.

    The country table is one aggregate by year: the price row and the count row
    of a year meet in it, and a year with one of them missing is left out, as
    an inner join of the two would.  Two rows of a kind in a year fail the job.
    """
    panel = route.branch(c, "detail").select(*PANEL_COLUMNS)
    is_price, is_count = F.col("row_class") == "country_price", F.col("row_class") == "country_count"
    prices = ["average_price_nominal_euros", "average_price_m2_nominal_euros"]
    by_year = c.filter(is_price | is_count).groupBy("year").agg(
        F.count_if(is_price).alias("__prices"), F.count_if(is_count).alias("__counts"),
        *[F.max(F.when(is_price, F.col(p))).alias(p) for p in prices],
        F.max(F.when(is_count, F.col("n_offers"))).alias("n_offers"))
    msg = F.concat(F.lit("more than one national row of a kind in "), F.col("year").cast("string"))
    whole = (F.when((F.col("__prices") > 1) | (F.col("__counts") > 1), F.raise_error(msg))
             .otherwise((F.col("__prices") == 1) & (F.col("__counts") == 1)))
    country = by_year.filter(whole).select(F.lit(country_name).alias("locality"), *prices, "year", "n_offers")
    return Cleaned(c, panel, country)


def clean_deliveries(raw: DataFrame, sheet_col: str = "sheet", thousands_sep: str | None = None,
                     country_name: str = COUNTRY_NAME) -> Cleaned:
    """Step 1: the commune panel and the country table from raw sheet rows.

    Nothing is kept in memory.  A job that reads more than one branch stages
    the classified rows first, as ``run`` does.
    """
    return split_classified(classify(raw, sheet_col, thousands_sep), country_name)


def entity_list(tables: DataFrame, table_idx: int, header_rows: int, name: str,
                occurrence: int = 1) -> DataFrame:
    """Step 2a: one column of one scraped table as an entity list ``(commune)``.

    ``tables`` is the output of ``sources.html.html_tables``.  The trailing
    marker (``Name †``) is dropped.
    """
    rows = table_rows(tables, table_idx, header_rows)
    col = column(rows, name, occurrence)
    return col.select(drop_trailing_marker(F.col(name)).alias("commune"))


def communes(current: DataFrame, former: DataFrame, harmonise: bool = True,
             sort: bool = False) -> DataFrame:
    """Step 2b: current and former lists stacked, spelling harmonised, distinct."""
    both = entities.stack([former, current])
    if harmonise:
        both = entities.harmonise(both, "commune", ENTITY_RULES)
    return entities.distinct_values(both, "commune", sort=sort)


def coverage(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Step 2c: panel localities missing from the entity list (empty = pass)."""
    return entities.missing_from(panel, "locality", dim, "commune")


def index_panel(panel: DataFrame, base: int = BASE_YEAR, how: str = "window") -> DataFrame:
    """Step 3a: both price measures indexed on the base year per locality."""
    return index.price_index(panel, ["locality"], "year", base, PRICE_MEASURES, how=how)


def index_and_series(panel: DataFrame, country: DataFrame, selected: list[str] | None = None,
                     base: int = BASE_YEAR, how: str = "window"):
    """Step 3b: the selected localities' series (long form) and their gap to the
    national index.  Returns ``(indexed, long_series, versus_country)``.

    The selection is a predicate on the window's key, so Spark applies it below
    the index.  The national series has a row per year."""
    indexed = index_panel(panel, base, how=how)
    chosen = series.select_entities(indexed, "locality", selected or SELECTED)
    long = series.long_series(chosen, ["locality"], "year", ["pl", "pl_m2"])
    nat = index.price_index(country.drop("locality"), [], "year", base,
                            {"average_price_m2_nominal_euros": ("p0_m2_country", "pl_m2_country")})
    versus = series.compare_to(chosen.select("locality", "year", "pl_m2"), nat, ["year"],
                               "pl_m2", "pl_m2_country")
    return indexed, long, versus


VALUES = ["n_offers", "average_price_nominal_euros", "average_price_m2_nominal_euros"]


def data_checks(c: Cleaned, previous: DataFrame | None = None, dim: DataFrame | None = None,
                thousands_sep: str | None = None) -> dict[str, DataFrame]:
    """Reports on a cleaned delivery, each with only the rows that need attention.

    ``casts``: number cells of detail rows that hold text (other than the
    placeholder ``*``) and were read as null (K3); ``nulls``: counts of null
    cells (C4, always one row); ``duplicates``: keys that repeat (K6);
    ``totals``: years whose offers do not add up to the published count (K1);
    ``churn``: localities that do not span the panel, and ``lineage``: those of
    them whose offers show that they were merged, split or renamed (K4); ``fingerprint`` of
    the panel (K5, always one row); with ``previous`` (an earlier panel),
    ``revisions`` of the years it has (K2), and with ``dim`` (``commune``),
    ``coverage``: localities that the entity list lacks (E3).
    """
    detail = route.branch(c.classified, "detail")
    lost = [F.when(F.col(f"{v}_text").isNotNull() & (F.col(f"{v}_text") != "*")
                   & lenient_double(f"{v}_text", thousands_sep).isNull(), F.lit(v)) for v in VALUES]
    casts = (detail.withColumn("columns", F.array_compact(F.array(*lost)))
             .filter(F.size("columns") > 0).select("locality", "year", "columns", *[f"{v}_text" for v in VALUES]))
    out = {
        "casts": casts,
        "nulls": checks.null_report(c.panel),
        "duplicates": checks.duplicate_keys(c.panel, ["locality", "year"]),
        "totals": checks.totals_match(c.panel, c.country, "year", "n_offers", "n_offers").filter("NOT ok"),
        "churn": checks.churn(c.panel, "locality", "year").filter("appeared OR vanished"),
        "lineage": lineage.lineage_events(c.panel, "locality", "year", "n_offers"),
        "fingerprint": checks.fingerprint(c.panel),
    }
    if previous is not None:
        out["revisions"] = checks.revisions(previous, c.panel, ["locality", "year"], VALUES).filter("kind <> 'added'")
    if dim is not None:
        out["coverage"] = coverage(c.panel, dim)
    return out


#: Reports that must be empty for a delivery to pass.
MUST_BE_EMPTY = ["schema", "casts", "duplicates", "revisions", "coverage", "totals"]


class CheckFailed(RuntimeError):
    """Checks of a delivery found rows; their reports are written."""


def run(spark: SparkSession, raw: DataFrame, out_dir: str, selected: list[str] | None = None,
        base: int = BASE_YEAR, country_name: str = COUNTRY_NAME, thousands_sep: str | None = None,
        previous: DataFrame | None = None, dim: DataFrame | None = None, fail_on: list[str] | None = None,
        headers: DataFrame | None = None, expected: list[str] | None = None) -> dict[str, str]:
    """The whole job: clean, check, index, write.

    The classified rows are staged once in the shared checkpoint folder (and
    removed at the end); the check reports (``data_checks``, under ``checks/``),
    the panel, the country table, the indexed panel (partitioned by year) and the
    plot-ready series of the selected localities (one folder per locality) are
    written from that staged copy.  A lost executor re-reads staged files
    instead of re-decoding every workbook.  With ``fail_on`` (names of reports,
    for instance ``MUST_BE_EMPTY``) a report that has rows stops the job after
    the reports are written and before any other output is.  With ``headers``
    (``path, part, columns``, see ``sheet_headers``) the layouts that differ from
    the ``expected`` names are reported first (``checks/schema``, K3), before any
    row is read, so a delivery that fails to be read leaves that report.  Returns the output paths.
    """
    schema_path = f"{out_dir.rstrip('/')}/checks/schema"
    if headers is not None:
        report = checks.drifted(checks.schema_versions(headers, expected), expected)
        write_table(report, schema_path)
        if "schema" in (fail_on or []) and not spark.read.schema(report.schema).parquet(schema_path).isEmpty():
            raise CheckFailed(f"checks with findings: schema (see {schema_path})")
    classified = stage(classify(raw, thousands_sep=thousands_sep), "classified", spark)
    try:
        c = split_classified(classified, country_name)
        out = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("panel", "country", "indexed", "series", "versus")}
        if headers is not None:
            out["checks/schema"] = schema_path
        failed = []
        for name, report in data_checks(c, previous, dim, thousands_sep).items():
            out[f"checks/{name}"] = path = f"{out_dir.rstrip('/')}/checks/{name}"
            write_table(report, path)
            if name == "lineage":
                drop_staged(report)
            if name in (fail_on or []) and not spark.read.schema(report.schema).parquet(path).isEmpty():
                failed.append(name)
        if failed:
            raise CheckFailed(f"checks with findings: {', '.join(failed)} (see {out_dir}/checks)")
        indexed, long, versus = index_and_series(c.panel, c.country, selected, base)
        write_table(c.panel, out["panel"])
        write_table(c.country, out["country"])
        write_table(indexed, out["indexed"], partition_by=["year"])
        write_series(long, out["series"], "locality")
        write_table(versus, out["versus"])
        return out
    finally:
        drop_staged(classified)
