"""Spark session settings used by the library, tests and the benchmark.

Everything here is ordinary Spark configuration.  The library itself never
creates a session; callers pass one in.  ``build_session`` is a convenience
for local runs (tests, bench) that applies the settings below.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the plans this library builds.
#  * AQE re-plans at stage boundaries: coalesces small shuffle partitions,
#    turns sort-merge joins into broadcast joins when the measured size of a
#    side is under the threshold, and splits skewed join partitions.
#  * The broadcast threshold is Spark's own size check (statistics at plan time,
#    measured shuffle sizes under AQE); no operator forces a broadcast of a
#    side whose size is not bounded.
#  * UTC, so year() of timestamp_ntz and oracle comparisons agree.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages and workbooks reach Python workers in Arrow batches of this many
    # rows; whole documents per row, so keep batches moderate.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
}


def _master_configured() -> bool:
    """True when spark-submit (or the environment) already names a master."""
    from pyspark import SparkConf

    if os.environ.get("SPARK_MASTER") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        return True
    return SparkConf().contains("spark.master")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pinax", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with BASE_CONF applied.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` only when nothing else
    names one; under spark-submit (``--master``) the submitted master is kept
    and this only adds settings.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not _master_configured():
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Where it is unset, ``fallback`` is used
    or, in a single local JVM (tests, a laptop), a temporary folder; the choice
    is registered with the SparkContext, so it is made once and
    ``DataFrame.checkpoint()`` works too.  On a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if fallback is None and (master == "local" or master.startswith("local[")):
            fallback = tempfile.mkdtemp(prefix="pinax-checkpoints-")
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        d = fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
