"""Cleaning pipeline over ``documents``: quality rules, near-duplicates, repeated passages,
source mixing, tokens.

``STAGES`` names the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns what the next one gets as ``docs``; all but the last return the columns
of ``documents`` (others are left behind, so none can clash).  ``run`` writes each stage's result as Parquet under
``spark.checkpoint.dir`` and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinax.llm import bpe, mixing, quality, queries, rlz, simhash
from pinax.llm.common import drop_staged, staged, staged_paths, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs.select(*COLUMNS), shingle=3, distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that an earlier document has."""
    cut = rlz.remove_repeats(docs.select(*COLUMNS), window=13)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs.select(*COLUMNS), queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS,
                       queries.MIX_SEED)
    return mixing.repeated_rows(mixed).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with the number of bytes they decode to."""
    path = public_tokenizers.path(queries.VOCABULARY)
    both = bpe.round_trip(docs.select(*COLUMNS), path, public_tokenizers.PATTERN)
    return both.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.octet_length("bytes").cast("long").alias("n_bytes"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: SQL can express neither the certified cutoffs, nor the components, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage has staged is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = set(staged_paths())
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(spark, [p for p in staged_paths()[:-1] if p not in before])
    return docs
