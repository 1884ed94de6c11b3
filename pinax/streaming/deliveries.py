"""New deliveries as a stream of files (the reference's "new data gets published").

The cleaning of ``plans.stages.classify`` is row-by-row (no state), so it runs
unchanged on a streaming DataFrame.  Each micro-batch then splits into the
commune panel and the country table, exactly like the batch step, compares
its panel rows with the rows earlier deliveries gave for the same years (a
revisions report: changed, added, removed), and writes all three under
``batch=<id>``: a batch re-run after a failure overwrites its own
folder, so the output is written once even though ``foreachBatch`` is
at-least-once.  Checkpoints go under the cluster's shared
``spark.checkpoint.dir``.

Deliveries arrive as delimited exports of the sheets (all cells as text, with
a header row); the sheet name is taken from the file name, e.g.
``deliveries/2022.csv`` -> sheet ``2022``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import checks
from ..plans import stages
from ..session import checkpoint_dir
from ..sources.files import drop_staged, file_tag, stage


def read_deliveries(spark: SparkSession, folder: str, headers: list[str], fmt: str = "csv",
                    sheet_pattern: str | None = None, max_files: int | None = None,
                    **options) -> DataFrame:
    """Streaming read of delivery files, every cell a string, plus ``sheet``
    (the file name without its last extension, or group 1 of ``sheet_pattern``
    on the path)."""
    schema = StructType([StructField(h, StringType()) for h in headers])
    r = spark.readStream.format(fmt).schema(schema).option("header", True).options(**options)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(folder)
    return df.withColumn("sheet", file_tag(sheet_pattern, strip="last"))


VALUES = stages.VALUES


def _newest_per_year(panel: DataFrame) -> DataFrame:
    """Rows of the newest batch of each year (one aggregation, then a semi join)."""
    newest = panel.groupBy("year").agg(F.max("batch").alias("batch"))
    return panel.join(newest, ["year", "batch"], "left_semi").drop("batch")


def _earlier_panel(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame | None:
    """The panel as earlier batches left it: per year, the newest delivery before
    this batch (a re-run batch does not see itself)."""
    try:
        old = spark.read.parquet(f"{out_dir}/panel")
    except AnalysisException:      # nothing written yet
        return None
    return _newest_per_year(old.filter(F.col("batch") < batch_id))


def _write_batch(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        classified = stage(stages.classify(batch), "delivery", spark)
        c = stages.split_classified(classified)
        try:
            old = _earlier_panel(spark, out_dir, batch_id)
            if old is not None:
                # K2: did this delivery change values already delivered for its years?
                years = c.panel.select("year").distinct()
                before = old.join(years, "year", "left_semi")
                rev = checks.revisions(before, c.panel, ["locality", "year"], VALUES)
                rev.write.mode("overwrite").parquet(f"{out_dir}/revisions/batch={batch_id}")
            c.panel.write.mode("overwrite").parquet(f"{out_dir}/panel/batch={batch_id}")
            c.country.write.mode("overwrite").parquet(f"{out_dir}/country/batch={batch_id}")
        finally:
            drop_staged(classified)
    return write


def latest_panel(spark: SparkSession, out_dir: str) -> DataFrame:
    """The panel as of the newest delivery of each year.

    A year delivered again replaces its earlier rows; one aggregation over the
    (batch, year) pairs, then a semi join - no window over the whole panel.
    """
    return _newest_per_year(spark.read.parquet(f"{out_dir}/panel"))


def start(raw: DataFrame, out_dir: str, name: str = "deliveries",
          available_now: bool = True) -> StreamingQuery:
    """Start the stream: cleaned panel and country rows under ``out_dir``.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps watching the folder.
    """
    spark = raw.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/pinax-streams/{name}"
    w = raw.writeStream.foreachBatch(_write_batch(out_dir)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()
