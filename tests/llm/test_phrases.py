"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pinax.llm import phrases
from tests.llm import data


def plain_phrases(rows, min_count=30, top=2000, covered=80):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i:i + k]] += 1
    frequent = {p: c for p, c in f.items() if c >= min_count}
    longer = Counter()
    for p, c in frequent.items():
        for k in (2, 3):
            for i in range(1, len(p) - k + 1):
                if k < len(p) - 1:
                    longer[p[0], *p[i:i + k]] = max(longer[p[0], *p[i:i + k]], c)
    best = {}
    for p, a in frequent.items():
        if len(p) < 3:
            continue
        cuts = [(2_000_000 * a // (f[p[:k + 1]] + f[p[0], *p[k + 1:]]), k, f[p[:k + 1]], f[p[0], *p[k + 1:]])
                for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        if not (p in longer and 100 * longer[p] >= covered * a):
            best.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
            for lang, xs in best.items() for i, x in enumerate(sorted(xs)[:top], 1)]


def texts(seed=5, n=150):
    """Few words, so that phrases recur; marks, blanks and odd characters between them."""
    r = random.Random(seed)
    vocab = ["a", "B", "the", "of", "é", "日本", "x-y", "A", "(q)", "7", "long" * 200, "n b", "w\u0000"]
    say = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"])
                            for _ in range(k))
    rows = [(i, say(r.randint(0, 80)), r.choice(["en", "en", "de", None, "und"]), None, 0) for i in range(n)]
    return rows + rows[:9] + [(1, None, None, None, None), (2, "", "fr", None, None), (3, " .;", "en", None, None),
                              (4, "hot pair " * 2000, "en", None, None)]


@pytest.mark.parametrize("budget", [1 << 20, 200, 7])
def test_phrases_equal_plain_counts(spark, budget):
    rows = texts()
    df = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(5)
    got = phrases.collocations(df, min_count=4, top=60, budget=budget)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"),
                          ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert data.multiset(got.collect()) == data.multiset(plain_phrases(rows, 4, 60))


def test_counts_past_64_bits(spark):
    rows = [(i, "big deal", "en", None, None) for i in range(5)]
    got = phrases.collocations(spark.createDataFrame(rows, data.DOC_SCHEMA), min_count=2, scale=2 * 10 ** 18).collect()
    assert [r.score for r in got] == [10 ** 18]


def test_colliding_codes_are_found(spark, monkeypatch):
    """With codes of few bits words collide; wider codes or other hashes are then taken."""
    real, asked = phrases.range_hashes, []

    def few(data, starts, ends, seed=0):
        asked.append(seed)
        return real(data, starts, ends, seed) & np.uint64(7) if seed == 0 else real(data, starts, ends, seed)

    rows = texts(6, 60)
    words = spark.createDataFrame([(1, 9), (1 + (1 << 40), 3), (5, 2), (5 + (1 << 40), 2), (9, 9)], "code long, n long")
    assert not phrases._told_apart(words, 5, 4) and phrases._told_apart(words, 6, 4) and phrases._told_apart(words, 5, 10)
    monkeypatch.setattr(phrases, "range_hashes", few)
    rb = spark.createDataFrame([r[:3] for r in rows], "i long, text string, lang string")
    counted = phrases._counted(rb.selectExpr("coalesce(lang, 'und') lang", "text"), 0, 1024).filter("kind = 1")
    assert not phrases._told_apart(counted.select("code", "n"), 8, 1)
    want = Counter()
    for r in rows:
        for w in re.findall(r"[^\x20\x09]+", re.sub(r"[.,;:!?\x0A-\x0D]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))):
            want[r[2] or "und", w] += 1
    assert Counter({(r.lang, r.word): r.n for r in counted.collect()}) == want


def test_a_plan_keeps_its_budget():
    r = np.random.default_rng(1)
    loads = {2: r.integers(0, 50, 1024), 3: r.integers(0, 30, 1024)}
    loads[2][5], loads[3][7] = 5000, 950
    plan = phrases._Plan(loads, 100)
    for kind in (2, 3):
        held = np.bincount(plan.first[kind][loads[kind] <= 100], weights=loads[kind][loads[kind] <= 100])
        assert held.max() <= 100
    assert plan.first[2][5] == -1 and plan.parts[7] == 10


def test_edges(spark, no_docs, clashing):
    assert phrases.collocations(no_docs).count() == 0
    rows = texts(7, 20)
    df = spark.createDataFrame(rows, data.DOC_SCHEMA)
    wide = clashing(df).selectExpr("*", "1 AS word", "2 AS code", "3 AS f", "4 AS phrase")
    assert phrases.collocations(wide, 3).count() == len(plain_phrases(rows, 3))
    assert phrases.collocations(df, 10 ** 6).count() == 0


def test_query(spark):
    from pinax.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert data.multiset(queries.op12_phrase_mining(spark, sf).collect()) == data.multiset(plain_phrases(rows))
