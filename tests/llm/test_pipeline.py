"""The pipeline's stages against plain versions of what each must do."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pinax.llm import mixing, queries
from pinax.llm.common import table
from tests.conftest import SF001, SF01
from tests.llm import data
from tests.parity import compare, duck


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF001, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF001), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage_drops_what_is_rejected(spark, stages):
    kept = {r.doc_id for r in queries.op5_quality_rules(spark, SF001).filter("kept").collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == kept


def test_near_duplicate_stage(stages):
    rows = [tuple(r) for r in stages[1].collect()]
    want = {c for _, _, c in data.simhash_reference(rows)}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_substring_stage(stages):
    rows = [tuple(r) for r in stages[2].collect()]
    want = {i: (n, sha) for i, _, n, sha in data.word_dedup_reference(rows)}
    import hashlib

    for r in stages[3].collect():
        left = " ".join(data.WORD.findall(r.text))
        assert hashlib.sha256(left.encode()).hexdigest() == want[r.doc_id][1] and r.n_chars == len(r.text)


def test_mix_stage(spark, stages):
    mixed = mixing.mix(stages[3], queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS, queries.MIX_SEED)
    want = Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})
    assert Counter(r.doc_id for r in stages[4].select("doc_id").collect()) == want


def test_token_stage(stages):
    import public_tokenizers

    rows = [tuple(r) for r in stages[4].collect()]
    want = Counter((r[0], r[1]) for r in
                   data.bpe_reference(rows, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN))
    assert Counter((r.doc_id, r.n_tokens) for r in stages[5].collect()) == want


def test_run_and_registration(spark, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(entry.queries())
    names = {int(q[2:].split("_")[0]) for q in queries.QUERIES}
    assert names == set(range(1, 14))
    from pinax.llm.common import staged_paths

    before = len(staged_paths())
    assert corpus_pipeline.run(spark, SF001).count() == stages[-1].count()
    assert len(staged_paths()) == before + 1  # only the result stays


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_parity(spark, name):
    ok, msg = compare(queries.QUERIES[name](spark, SF01), duck(SF01), queries.ORACLE[name])
    assert ok, msg


def test_stages_take_odd_tables(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, no_docs, docs.withColumn("ids", F.lit(1)).withColumn("copies", F.lit(2))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, str(tmp_path))
            out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == corpus_pipeline.COLUMNS
