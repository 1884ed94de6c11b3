"""Near-duplicates and repeated passages against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinax.llm import anchors, components, rlz, simhash, suffixes
from pinax.llm.common import WORD, range_hashes, utf8
from tests.llm import data


def words_sha(text):
    kept = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), " ")
    return F.sha2(F.encode(kept, "UTF-8"), 256)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [1 << 16, 2])
def test_byte_repeats(spark, seed, crowd):
    rows = data.documents(seed)
    df = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(5)
    got = suffixes.remove_repeats(df, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                                          F.sha2("kept", 256))
    assert data.multiset(got.collect()) == data.multiset(data.byte_dedup_reference(rows))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [1 << 17, 2])
def test_word_repeats(spark, seed, crowd):
    rows = data.documents(seed)
    df = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(5)
    got = rlz.remove_repeats(df, crowd=crowd).select("doc_id", "n_words", "n_removed", words_sha(F.col("text")))
    assert data.multiset(got.collect()) == data.multiset(data.word_dedup_reference(rows))


def test_factors_name_their_source(spark):
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, say("p", 30)), (2, say("q", 30)), (5, "new " + say("p", 20) + " " + say("q", 25) + " end")]
    spans, copies = rlz.factors(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.start, r.end, r.source_id) for r in spans.distinct().collect()}
    covered = {(i, s) for a, b, s in got for i in range(a, b)}
    assert covered == {(i, 1) for i in range(1, 21)} | {(i, 2) for i in range(21, 46)}


def test_untouched_text_is_unchanged(spark):
    text = "  odd\tspacing \n\n stays " + " ".join(map(str, range(40))) + "\n"
    out = rlz.remove_repeats(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: None}


def test_anchors_are_in_every_window():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab"), 600))
    d, offs = utf8(__import__("pyarrow").array([text, "", text[:50]]))
    u = anchors.byte_units(d, offs, 8)
    at, row, h = anchors.anchors(u, 30, 8)
    for r, (a, b) in enumerate(zip(offs, offs[1:])):
        mine = {int(x): int(g) for x, q, g in zip(at, row, h) if q == r}
        for i in range(a, b - 30 + 1):
            inside = [x for x in mine if i <= x <= i + 22]
            assert inside
            assert min(mine[x] for x in inside) == min(int(g) for g in u.grams[i:i + 23])


def test_suffix_sort_against_python():
    rng = np.random.default_rng(1)
    buf = rng.choice(list(b"ab"), 400).astype(np.uint8)
    starts = rng.integers(0, 380, 90)
    sizes = np.minimum(rng.integers(1, 21, 90), 400 - starts)
    group = np.sort(rng.integers(0, 4, 90))
    order, common = suffixes.suffix_sort(buf, starts, sizes, group)
    text = [buf[s:s + n].tobytes() for s, n in zip(starts, sizes)]
    for g in range(4):
        mine = order[group == g]
        assert [text[i] for i in mine] == sorted(text[i] for i in np.flatnonzero(group == g))
        for a, b, c in zip(mine, mine[1:], common[group == g][1:]):
            n = 0
            while n < min(len(text[a]), len(text[b])) and text[a][n] == text[b][n]:
                n += 1
            assert c == n


def test_a_misleading_hash_is_noticed():
    data_ = np.frombuffer(b"abcabd", np.uint8)
    p, q = np.array([0]), np.array([3])
    three, two = np.array([3]), np.array([2])
    assert suffixes._verified(data_, p, three, q, three, two, three)
    assert not suffixes._verified(data_, p, three, q, three, three, three)
    assert not suffixes._verified(data_, q, three, p, three, two, three)


def test_range_hashes_depend_on_bytes_and_length():
    d = np.frombuffer(b"abab\0\0b", np.uint8)
    h = range_hashes(d, np.array([0, 2, 4, 4]), np.array([2, 4, 5, 6]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_simhash_against_brute_force(docs, rows):
    got = [(r.doc_id, f"{r.fingerprint & (2 ** 64 - 1):016x}", r.component_id)
           for r in simhash.near_duplicates(docs).collect()]
    assert data.multiset(got) == data.multiset(data.simhash_reference(rows))


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_join_exactly_what_is_near(spark, monkeypatch, bucket):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40)
    fps = set()
    for s in seeds.tolist():
        for _ in range(12):
            x = s
            for b in rng.integers(0, 63, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    roots = dict(components.components(simhash.links(df, 3)).collect())
    group = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((group[a], group[b]))
                group = {f: x if g == y else g for f, g in group.items()}
    assert {f: roots.get(f, f) for f in fps} == group


def test_plans_cover_all_pairs():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for total in (10, 10 ** 5, 10 ** 9):
        parts = simhash.plan(sample, total, 3)
        assert sorted(b for g, _ in parts for b in g) == sorted({b for g, _ in parts for b in g})
        searched = sum(t + 1 for _, t in parts)
        assert searched == 3 + 1  # four differing bits are needed to exceed every threshold


def test_deduplicate_keeps_one_row_of_each_class(docs, rows):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    classes = {}
    for i, _, c in data.simhash_reference(rows):
        classes.setdefault(c, set()).add(i)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(classes, key=str)


def test_components_of_a_long_path(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = dict(components.components(df).collect())
    assert got == {**{i: 0 for i in range(1, n + 1)}, 2000: 1999}


@pytest.mark.parametrize("run", [
    lambda d: suffixes.remove_repeats(d), lambda d: rlz.remove_repeats(d),
    lambda d: simhash.near_duplicates(d), lambda d: simhash.deduplicate(d)])
def test_empty_tables(no_docs, run):
    assert run(no_docs).count() == 0


def test_clashing_columns(docs, clashing):
    wide, n = clashing(docs), docs.count()
    assert suffixes.remove_repeats(wide).count() == n
    out = rlz.remove_repeats(wide)
    assert out.count() == n and len({c.lower() for c in out.columns}) == len(out.columns)
    assert simhash.deduplicate(wide).columns == wide.columns


@pytest.mark.parametrize("seed", range(4))
def test_passage_index_and_parse(seed):
    """Longest earlier sequences and greedy factors, against plain loops."""
    import random

    import numpy as np

    r = random.Random(seed)
    passages = [[r.randrange(3) for _ in range(r.choice([0, 1, 5, 20, 37]))] for _ in range(25)]
    passages += passages[:3]
    ids = [r.randrange(12) for _ in passages]
    word = np.array([w for p in passages for w in p], np.int64)
    size = np.array([len(p) for p in passages])
    upto = np.cumsum(size)
    first = upto - size
    record = np.repeat(np.arange(len(passages)), size)
    index = rlz.PassageIndex(word, upto[record] - np.arange(len(word)))
    longest, source = index.longest_before(np.array(ids)[record])
    for n, p in enumerate(passages):
        for i in range(len(p)):
            best, by = 0, ids[n]
            for k in range(1, len(p) - i + 1):
                have = [ids[m] for m, q in enumerate(passages) if ids[m] < ids[n]
                        and any(q[j:j + k] == p[i:i + k] for j in range(len(q) - k + 1))]
                if not have:
                    break
                best, by = k, min(have)
            assert (longest[first[n] + i], source[first[n] + i]) == (best, by)
    begin, end = rlz.parsed(longest, first, upto)
    want = []
    for n in range(len(passages)):
        at = first[n]
        while at < upto[n]:
            want.append((at, at + max(1, longest[at])))
            at = want[-1][1]
    assert list(zip(begin.tolist(), end.tolist())) == want


def test_words_that_fool_polynomial_hashes(spark):
    tm = lambda n, a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{head} {w}", None, None, None) for i, w in
            enumerate([tm(1024, "a", "b"), tm(1024, "b", "a"), tm(8192, "a", "b"), tm(8192, "b", "a"), tm(1024, "a", "b")])]
    df = spark.createDataFrame(rows, data.DOC_SCHEMA)
    got = rlz.remove_repeats(df).select("doc_id", "n_words", "n_removed", words_sha(F.col("text")))
    assert data.multiset(got.collect()) == data.multiset(data.word_dedup_reference(rows))


@pytest.mark.parametrize("split", [1 << 15, 3, 1])
def test_links_of_split_keys(spark, monkeypatch, split):
    """Fingerprints crowd around a few centres; keys are split, and components stay the same."""
    import random

    from pinax.llm import simhash
    from pinax.llm.components import components

    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split)
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3)).collect()
    got = {r.node: r.root for r in found}
    group = {x: x for x in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {k: new if v == old else v for k, v in group.items()}
    least = {}
    for x, g in group.items():
        least[g] = min(least.get(g, x), x)
    assert {x: got.get(x, x) for x in signed} == {x: least[g] for x, g in group.items()}


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_a_passage_of_very_many_texts(spark, monkeypatch, most):
    """Copies of a passage are told by the task that meets them, with ids in no order; the result stays whole."""
    import random

    from pinax.llm import anchors

    monkeypatch.setattr(anchors, "MET_BYTES", most)
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(45))
    say = lambda k: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(k))
    rows = [(i, f"{say(20)} {passage} {say(20)}" if i % 3 else f"{say(3)} {passage}", None, None, None) for i in range(150)]
    rows += [(i, f"{passage} x {passage}", None, None, None) for i in range(150, 156)] + [(None, passage + " end", None, None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(3)
    got = rlz.remove_repeats(df).select("doc_id", "n_words", "n_removed", words_sha(F.col("text")))
    assert data.multiset(got.collect()) == data.multiset(data.word_dedup_reference(rows))
    kept = suffixes.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert data.multiset(kept.collect()) == data.multiset(data.byte_dedup_reference(rows))
