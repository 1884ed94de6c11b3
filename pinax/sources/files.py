"""File sources and sinks (A3-A6, A10-A12) on Spark's own readers and writers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..session import checkpoint_dir


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType | str,
             header: bool = True, encoding: str = "UTF-8", sep: str = ",",
             partitions: int | None = None) -> DataFrame:
    """CSV under an explicit schema (A5); ``.gz`` files are decompressed by Spark.

    * A schema instead of inference: no extra pass over the data, and types do
      not drift between deliveries.
    * ``encoding="ISO-8859-1"`` decodes Latin-1 files correctly (A10), which
      makes per-character repairs such as ``\\351 -> é`` unnecessary.
    * gzip is not splittable, so one file is one task; ``partitions`` spreads
      the rows before heavy downstream work.
    * With a header, its names must equal the schema's (``enforceSchema=false``),
      and a cell that does not fit its type fails the job (``FAILFAST``): columns
      in another order give an error, not wrong values.
    """
    df = (spark.read.schema(schema).option("header", header).option("encoding", encoding).option("sep", sep)
          .option("enforceSchema", not header).option("mode", "FAILFAST").csv(paths))
    return df.repartition(partitions) if partitions else df


def numbered_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8",
                   glob: str | None = None, least_lines: int = 0) -> DataFrame:
    """``(path, name, line_no, line)`` of text files of any size, gzip included.

    Files are scanned in splits by many tasks.  A first scan counts the lines of
    each split; the prefix sums of these counts, a row for each split, give the
    number of a split's first line, and a line's place in its split does the
    rest.  No file is ever one row or one task (a gzip file is one split).
    ``encoding`` is any in which a line feed is one byte; a byte-order mark is
    dropped.  A file with lines, but fewer than ``least_lines``, fails the job.
    """
    options = {"pathGlobFilter": glob} if glob else {}
    read = spark.read.options(recursiveFileLookup="true", **options).text(paths)
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
                        F.col("_metadata.file_block_start").alias("__block"),
                        F.monotonically_increasing_id().alias("__id"), "value")
    # Within a split ids go up by one in reading order; both scans have the same splits.
    splits = lines.groupBy("path", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                           F.sum("__n").over(Window.partitionBy("path")).alias("__lines"))
    if least_lines:
        short = F.concat(F.lit(f"no header after {least_lines - 1} rows in "), F.col("path"))
        starts = starts.filter(F.when(F.col("__lines") < least_lines, F.raise_error(short)).otherwise(F.lit(True)))
    line_no = F.col("__before") + F.col("__id") - F.col("__first") + 1
    raw = F.col("value").cast("binary")
    text = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(raw, encoding)
    text = F.when(line_no == 1, F.regexp_replace(text, r"\A\x{FEFF}", "")).otherwise(text)
    return lines.join(starts, ["path", "__block"]).select(
        "path", "name", line_no.alias("line_no"), text.alias("line"))


def joined_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``lines`` with the lines of a record that holds line breaks in quotes put together, under its first line's number.

    A line with an odd number of quotes opens or closes a field that goes on;
    only these lines are ordered within their file, and paired.  Only the lines
    of such records are joined and grouped; a record must fit a row.
    """
    odd = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    turns = (lines.filter(odd % 2 == 1).select("path", "line_no")
             .withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))))
    spans = turns.groupBy("path", F.floor((F.col("nth") + 1) / 2).alias("pair")).agg(
        F.min("line_no").alias("record"), F.max("line_no").alias("last"))
    inside = spans.select("path", "record", F.explode(F.sequence("record", "last")).alias("line_no"))
    marked = lines.join(inside, ["path", "line_no"], "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    whole = marked.filter(F.col("record").isNotNull()).groupBy("path", "name", F.col("record").alias("line_no")).agg(
        F.array_join(parts, "\n").alias("line"))
    return marked.filter(F.col("record").isNull()).drop("record").unionByName(whole)


def read_sheet_exports(spark: SparkSession, paths: str | list[str], header: list[str],
                       skip_rows: int = 0, sep: str = ",", encoding: str = "UTF-8",
                       glob: str = "*.csv", tag_col: str = "sheet", line_breaks: bool = False) -> DataFrame:
    """Delimited exports of sheets with preamble rows before the header (A2), of any size.

    The CSV reader has no "skip the first k lines" option and splits files
    across tasks.  Here lines are numbered by ``numbered_lines``: lines
    ``1..skip_rows`` are dropped, line ``skip_rows + 1`` must equal the declared
    ``header`` (else the job fails), and the rest is parsed with the built-in
    ``from_csv`` - all in the JVM, by as many tasks as the files have splits.
    The header line is parsed the same way (quoted headers match), a leading
    byte-order mark is dropped, and a file too short to hold a header fails
    the job.  (A 0-byte file is skipped by Spark's file listing and adds no
    rows; the per-year checks - totals, churn - are where a missing sheet shows.)
    With ``line_breaks`` a quoted field may hold some (``joined_records``), and
    a doubled quote in it stands for one.
    """
    lines = numbered_lines(spark, paths, encoding, glob, least_lines=skip_rows + 1)
    lines = joined_records(lines) if line_breaks else lines
    after = lines.filter(F.col("line_no") > skip_rows)
    tag = F.substring_index("name", ".", 1).alias(tag_col)
    # One column more than declared: a longer header or data row shows up in it.
    ddl = ", ".join(f"`c{i}` string" for i in range(len(header) + 1))
    options = {"sep": sep} | ({"multiLine": "true", "escape": "\""} if line_breaks else {})
    parsed = after.select(tag, "line_no", F.from_csv("line", ddl, options).alias("r"), F.length("line").alias("len"))
    extra = F.col(f"r.c{len(header)}")
    cells = F.array(*[F.col(f"r.c{i}") for i in range(len(header))])
    expected = F.array(*[F.lit(h) for h in header])
    msg = F.concat(F.lit("header differs from the declared one in "), F.col(tag_col))
    is_header = F.col("line_no") == skip_rows + 1
    long = F.concat(F.lit("a row has more cells than the header in "), F.col(tag_col))
    checked = parsed.filter(F.when(is_header & (~cells.eqNullSafe(expected) | extra.isNotNull()), F.raise_error(msg))
                             .when(extra.isNotNull(), F.raise_error(long))
                             .otherwise(F.lit(True)))
    body = checked.filter((F.col("line_no") > skip_rows + 1) & (F.col("len") > 0))
    return body.select(*[F.col(f"r.c{i}").alias(h) for i, h in enumerate(header)], tag_col)


def file_headers(spark: SparkSession, paths: str | list[str], skip_rows: int = 0, sep: str = ",",
                 encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """``(path, part, columns)``: the names in the header line of each delimited file, read in tasks."""
    lines = numbered_lines(spark, paths, encoding, glob).filter(F.col("line_no") == skip_rows + 1)
    cell = r'("(?:[^"]|"")*"|[^"%s]*)%s' % (re.escape(sep), re.escape(sep))  # each ends at a separator
    cells = F.regexp_extract_all(F.concat("line", F.lit(sep)), F.lit(cell), F.lit(1))
    names = F.transform(cells, lambda c: F.replace(F.regexp_replace(c, r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return lines.select("path", F.lit(None).cast("string").alias("part"), names.alias("columns"))


def read_csv_checked(spark: SparkSession, paths: str | list[str], schema: StructType | str, header: bool = True,
                     encoding: str = "UTF-8", sep: str = ",", glob: str | None = None) -> DataFrame:
    """CSV whose bad rows are told, not fatal: the schema's columns and ``bad_file, bad_line, bad_text``.

    A row with a cell that does not fit its type, or with too few or too many
    cells, has the last three filled, with the file, the number of its line and
    the line as it stands; all others have them null.  With ``header`` the first
    line of each file must hold the schema's names, else it is such a row too.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    asked = StructType([*schema.fields, StructField("__bad", StringType())])
    lines = numbered_lines(spark, paths, encoding, glob)
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = lines.filter(F.length("line") > 0).withColumn("r", F.from_csv("line", _ddl(asked), options))
    bad = F.col("r.__bad").isNotNull()
    if header:
        names = F.from_csv("line", ", ".join(f"`c{i}` string" for i in range(len(schema) + 1)), {"sep": sep})
        found = F.array(*[names[f"c{i}"] for i in range(len(schema) + 1)])
        expected = F.array(*[F.lit(f.name) for f in schema], F.lit(None).cast("string"))
        is_header = (F.col("line_no") == 1) & found.eqNullSafe(expected)
        parsed = parsed.filter(~is_header)
        bad = bad | (F.col("line_no") == 1)
    when_bad = lambda c: F.when(bad, c)
    return parsed.select(*[F.when(~bad, F.col("r")[f.name]).alias(f.name) for f in schema],
                         when_bad(F.col("path")).alias("bad_file"), when_bad(F.col("line_no")).alias("bad_line"),
                         when_bad(F.col("line")).alias("bad_text"))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


BAD = ["bad_file", "bad_line", "bad_text"]


def quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write ``read_csv_checked`` rows in one scan, and return clean and quarantined rows.

    The table under ``path`` has two partitions, ``bad=false`` and ``bad=true``;
    each of the frames reads one of them.
    """
    spark = checked.sparkSession
    marked = checked.withColumn("bad", F.col("bad_line").isNotNull())
    marked.write.mode("overwrite").partitionBy("bad").parquet(path)
    table = spark.read.schema(marked.schema).parquet(path)
    return (table.filter(~F.col("bad")).drop("bad", *BAD),
            table.filter("bad").select(*[F.col(c).alias(c.removeprefix("bad_")) for c in BAD]))


def file_tag(pattern: str | None = None, strip: str = "all"):
    """Column naming each row's source file.

    Without ``pattern``: the file name with all extensions removed
    (``strip="all"``: ``part-1.snappy.parquet`` -> ``part-1``) or only the last
    one (``strip="last"``: ``2022.rev2.csv`` -> ``2022.rev2``), computed from
    ``_metadata.file_name`` with string functions - a per-row regex over the
    whole path costs more than the scan itself.  With ``pattern``: group 1 of
    the pattern applied to the full path.
    """
    if pattern is not None:
        return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    name = F.col("_metadata.file_name")
    if strip == "last":
        return F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.substring_index(name, ".", 1)


def read_tagged(spark: SparkSession, paths: str | list[str], fmt: str = "parquet",
                tag_col: str = "source", pattern: str | None = None,
                schema: StructType | str | None = None, **options) -> DataFrame:
    """Read many files in one scan and tag each row with its origin (A3, A4).

    Without ``schema`` the inputs must have equal column names and types; each
    input's schema is looked up (metadata only) and a difference is an error, so
    nothing is silently filled or dropped.

    The tag comes from the hidden ``_metadata`` column (``file_tag``), so there
    is no driver loop of reads and unions.  Directories like ``year=2010`` are
    partition columns by Spark's own discovery and need no tag.
    """
    read = lambda: spark.read.format(fmt).options(**options)
    if schema is None:
        each = [paths] if isinstance(paths, str) else list(paths)
        found = [read().load(p).schema for p in each]
        for p, s in zip(each, found):
            if [(f.name, f.dataType) for f in s] != [(f.name, f.dataType) for f in found[0]]:
                raise ValueError(f"{p} has columns {s.simpleString()}, {each[0]} has {found[0].simpleString()}")
        schema = found[0]
    df = read().schema(schema).load(paths)
    return df.withColumn(tag_col, file_tag(pattern))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite", **options) -> None:
    """Persist a clean table for the next stage (A11).  No ``coalesce(1)``: every
    task writes its own files.  CSV gets a header (``read_csv`` expects one in
    every part file).  With ``partition_by`` the rows are rebalanced on these
    columns first, so a folder holds few files and a large one is still split."""
    if fmt == "csv":
        options = {"header": True, **options}
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_series(df: DataFrame, path: str, entity: str, fmt: str = "parquet") -> None:
    """One folder per entity (A12), ready for per-entity plotting or pruning.

    ``rebalance`` on the entity column groups each entity's rows into few files,
    and AQE splits an entity that holds a large share of the rows over several
    tasks instead of one.
    """
    df.hint("rebalance", entity).write.mode("overwrite").format(fmt).partitionBy(entity).save(path)


def write_series_clustered(df: DataFrame, path: str, entity: str, order_col: str, files: int | None = None) -> None:
    """Series of very many entities (A12) in few files: sorted by entity, and each file holds a range of them.

    The number of files is that of the range partitions (``files``, else Spark's
    own number), not of the entities, and one with very many rows is cut over
    several.  A reader that asks for some entities skips files and row groups by
    their statistics (``read_series``).
    """
    cols = [entity, order_col]
    ranged = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def read_series(spark: SparkSession, path: str, entity: str, wanted: list | None = None) -> DataFrame:
    """Series written by ``write_series_clustered``, of the ``wanted`` entities: a filter that reaches the scan."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(entity).isin(wanted)) if wanted is not None else rows


def stage(df: DataFrame, name: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    whole upstream plan) and lets several branches share one computation.  The
    folder is ``spark.checkpoint.dir`` as set by the cluster; ``drop_staged``
    removes it.
    """
    spark = spark or df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/{name or 'stage'}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(staged: DataFrame) -> None:
    """Remove the files of a frame returned by ``stage``, once its readers are done."""
    spark = staged.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        if "/pinax-stage/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
