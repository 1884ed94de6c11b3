"""Fill-in-middle: boundary set, cuts and the way back."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinax.llm import fim
from tests.llm import data

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain_fim(rows, rate=100, spm_rate=50):
    out = []
    for r in rows:
        text = r[1] or ""
        units = UNIT.findall(text)
        digest = hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
        n = len(units)
        p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b, c = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((r[0], n, "plain", None, None, text))
        elif h[3] % 100 < spm_rate:
            out.append((r[0], n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"))
        else:
            out.append((r[0], n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_boundary_set(seed):
    r = np.random.default_rng(seed)
    dense = np.arange(70_000, 90_000)
    parts = [r.integers(0, 1 << 18, [5, 3000, 100_000, 0, 1, 60_000][seed]), dense if seed % 2 else dense[:3],
             r.integers(1 << 30, (1 << 30) + 50, 20)]
    values = np.unique(np.concatenate(parts))
    s = fim.BoundarySet(values)
    assert np.array_equal(s.select(np.arange(len(values))), values)
    asked = np.unique(np.concatenate([values, values + 1, r.integers(0, 1 << 31, 1000), [0]]))
    assert np.array_equal(s.rank(asked), np.searchsorted(values, asked))


def test_every_kind_of_container():
    values = np.concatenate([np.arange(0, 65_536, 3), 65_536 + np.arange(0, 60_000, 20), 131_072 + np.arange(65_536)])
    s = fim.BoundarySet(values)
    assert [type(c).__name__ for c in s.containers] == ["_Bitmap", "_Array", "_Runs"]
    assert np.array_equal(s.select(np.arange(len(values))[::-1]), values[::-1])
    assert np.array_equal(s.rank(np.arange(200_000)), np.searchsorted(values, np.arange(200_000)))


def lined(rows):
    extra = ["\n", "\n\n\n", "a\n\nb", "one\ntwo\n", "x<P>y\nz", "<S", "<S\n>", "é\n日\n" * 4000, "\n" * 70_000,
             "a\r\nb\rc", "<<M>>\n", "<\nP>\n<\n" * 3]
    return rows + [(5000 + i, t, None, None, None) for i, t in enumerate(extra)]


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 100), (0, 50)])
def test_cuts_and_way_back(spark, rows, rate, spm_rate):
    rows = lined(rows)
    df = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(3)
    made = fim.fill_in_middle(df, rate=rate, spm_rate=spm_rate)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert data.multiset(got.collect()) == data.multiset(plain_fim(rows, rate, spm_rate))
    back = made.select("doc_id", fim.restored())
    assert data.multiset(back.collect()) == data.multiset((r[0], r[1] or "") for r in rows)


def test_edges(docs, no_docs, clashing):
    assert fim.fill_in_middle(no_docs).count() == 0
    wide = clashing(docs).withColumns({"form": F.lit(1), "Output": F.lit(2)})
    got = fim.fill_in_middle(wide)
    assert got.count() == docs.count() and "a column" in got.columns and "Output" not in got.columns


def test_query(spark):
    from pinax.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op11_fill_in_middle(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"),
                          ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*w[:5], sha(w[5]), sha(r[1] or "")) for w, r in zip(plain_fim(rows), rows)]
    assert data.multiset(got.collect()) == data.multiset(want)
