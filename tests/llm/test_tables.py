"""Slots, url rules, search, mixing."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pinax.llm import hamming_search, mixing, shards, urls
from pinax.llm.queries import URL_RULES
from tests.llm import data


def test_shards_are_balanced_and_numbered(docs, rows):
    placed, slot_map = shards.shard(docs, 4)
    got = placed.collect()
    want = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert data.multiset((r.id, r.size, r.text_crc32) for r in got) == data.multiset(want)
    for k in range(4):
        slots = sorted(r.slot for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    load = Counter()
    for r in got:
        load[r["shard"]] += r.size
    assert max(load.values()) - min(load.values()) <= max(w[1] for w in want)
    assert slot_map.version == 2
    again, _ = shards.shard(docs.repartition(3), 4)
    assert data.multiset(again.collect()) == data.multiset(got)


def test_the_map_is_edited_by_few_moves():
    r = random.Random(2)
    sizes = [int(r.paretovariate(1.2) * 1000) for _ in range(shards.SLOTS)]
    first = shards.SlotMap.even(40)
    second = first.rebalanced(sizes)
    load = second.loads(sizes)
    assert max(load) - min(load) <= 0.002 * sum(load) / 40 + min(sizes) or max(sizes) > sum(sizes) / 40
    assert second.rebalanced(sizes).shards == second.shards  # nothing left to move
    third = second.grown(sizes)
    assert third.version == 3 and all(b in (a, 40) for a, b in zip(second.shards, third.shards))
    assert third.loads(sizes)[40] > 0.9 * sum(sizes) / 41


def test_the_stored_map_is_edited_by_the_next_run(spark, tmp_path):
    """A second run on grown data loads version 2, moves few slots and stores version 3."""
    folder, rows = str(tmp_path / "map"), [(i, "x" * (50 + i % 700)) for i in range(6000)]
    frame = lambda n: spark.createDataFrame(rows[:n], "doc_id long, text string")
    _, first = shards.shard(frame(5000), 8, folder=folder)
    assert first.version == 2 and shards.load_map(spark, folder, 1) == shards.SlotMap.even(8)
    again, same = shards.shard(frame(5000), 8, folder=folder)
    assert same == first  # nothing to move: no new version
    placed, third = shards.shard(frame(6000), 8, folder=folder)
    assert third.version == 3 and 0 < third.moved(first) < 0.1 * shards.SLOTS and shards.load_map(spark, folder) == third
    assert shards.load_map(spark, folder, 2) == first
    got = placed.collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        assert r["shard"] == third.shards[r.virtual_slot] and r.map_version == 3
    assert max(load.values()) - min(load.values()) <= 800
    sizes = [0] * shards.SLOTS
    for r in got:
        sizes[r.virtual_slot] += r["size"]
    grown = shards.grow(spark, sizes, folder)
    assert grown.version == 4 and grown.n_shards == 9 and all(b in (a, 8) for a, b in zip(third.shards, grown.shards))
    with pytest.raises(ValueError):
        shards.shard(frame(10), 8, folder=folder)
    (tmp_path / "map" / "version=9").mkdir()  # half written
    assert shards.load_map(spark, folder).version == 4 and shards.load_map(spark, str(tmp_path / "none")) is None


def test_a_row_repeated_very_often_is_spread(spark):
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 50).alias("text"))
    placed, _ = shards.shard(df, 4)
    load = Counter(r["shard"] for r in placed.collect())
    assert sum(load.values()) == 5000 and max(load.values()) - min(load.values()) <= shards.LOT


def test_shard_edges(no_docs, docs, clashing):
    assert shards.shard(no_docs, 5)[0].count() == 0
    assert shards.shard(clashing(docs), 5)[0].count() == docs.count()


URLS = ["http://a.net/x", "https://A.Example.NET/en/1?q=/de/", "http://example.net/en", "http://example.net/en/",
        "http://net/", "http://net", "http://xnet/", "https://b.example.com/de/2#t", "https://example.com/DE/",
        "http://x.org/fr/", "http://x.org/fr", "http://org/fr/q", "mailto:x", None, "", "://", "http:///path",
        "http://user@h.net:80/", "http://a.net?x", "ftp://Ünet.net/é", "x://y://z.net/", "http://.net/",
        "http://a\n.net/x", "http://example.com.net/de/"]


def _judged(url, rules=tuple(URL_RULES)):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, "block" if best and not best.allow else "allow"


def _verdicts(spark, found, rules):
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect()}


def test_url_verdicts(spark):
    assert _verdicts(spark, URLS, URL_RULES) == {i: _judged(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("seed", range(14))
def test_url_rules_of_one_kind_and_random_ones(spark, seed):
    r = random.Random(seed)
    made = [urls.Rule(r.choice(["net", "org", "example.net", "example.com", "a.net", ""]), r.choice(["", "/", "/en/", "/d"]),
                      [False, True, r.random() < 0.5][seed % 3]) for _ in range(r.choice([1, 2, 2, 5]))]
    rules = list({x.key: x for x in made}.values())
    got = {i: x[2:] for i, x in _verdicts(spark, URLS, rules).items()}
    for i, u in enumerate(URLS):
        host, path, key, verdict = _judged(u, rules)
        assert got[i] == (key, verdict), (u, rules)


def test_many_url_rules(spark):
    rules = [urls.Rule(f"h{i}.net", "/" if i % 3 else "/en/", i % 2 == 0) for i in range(20_000)]
    found = [f"http://{'www.' if i % 5 else ''}h{i}.net/{'en/' if i % 7 else ''}x" for i in range(0, 26_000, 13)]
    by_host = {x.host: x for x in rules}
    want = {}
    for i, u in enumerate(found):
        host, path, _, _ = _judged(u, ())
        rule = by_host.get(host.removeprefix("www."))
        fits = rule is not None and path.startswith(rule.path)
        want[i] = (host, path, rule.key if fits else None, "block" if fits and not rule.allow else "allow")
    assert _verdicts(spark, found, rules) == want


def test_url_reserved_names(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    with pytest.raises(ValueError):
        urls.judge(df.withColumn("_url_keys", F.lit(1)), URL_RULES)
    wide = df.select("*", F.lit(1).alias("_keys"), F.lit(2).alias("_key"), F.lit(3).alias("_allow"), F.lit(4).alias("key"))
    assert {"_keys", "_key", "_allow", "key"} < set(urls.judge(wide, URL_RULES).columns)


def test_cascade_is_exact(spark, monkeypatch):
    listed = spark.range(0, 300).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(0, 6000).select(F.concat(F.lit("k"), "id").alias("key"))
    for name, value in (("BITS_PER_KEY", 2), ("MOST_BITS_PER_KEY", 2)):  # many false positives, so several levels
        monkeypatch.setattr(urls, name, value)
    cascade = urls.Cascade(listed, universe, 6000)
    assert len(cascade.levels) > 2
    got = {r[0] for r in universe.filter(cascade.has(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(300)}


def test_the_first_level_is_built_again_when_too_many_pass(spark):
    listed = spark.range(0, 50).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(0, 200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urls.Cascade(listed, universe, 50)  # a universe said to be smaller than it is
    assert all(len(x.words) <= 50 * urls.MOST_BITS_PER_KEY for x in cascade.levels)
    assert universe.filter(cascade.has(F.col("key"))).count() == 50


def test_url_edges(spark, clashing):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    assert urls.judge(clashing(df), URL_RULES).count() == len(URLS)
    assert urls.judge(df, []).filter("rule is not null or verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("bits,n,k", [(64, 150, 5), (12, 300, 7), (7, 40, 60)])
def test_search_against_brute_force(spark, bits, n, k):
    r = random.Random(bits)
    rows = [(i, [r.gauss(0, 1) for _ in range(bits)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)] + [(5000, None), (None, rows[0][1]), (5001, [1.0]),
                                                        (5002, [float("nan")] * bits), (5003, [None] * bits)]
    rows += [rows[2], rows[2]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = hamming_search.search(df, df.filter(F.col("vec_id") % 20 == 0), k, bits)
    codes = {i: tuple(x is not None and x > 0 for x in v) for i, v in rows
             if i is not None and v is not None and len(v) == bits}
    want = []
    for q in codes:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:k]
            want += [(q, j + 1, i, d) for j, (d, i) in enumerate(near)]
    assert data.multiset(got.collect()) == data.multiset(want)


def test_search_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming_search.search(df, df, 3, 64).count() == 0
    one = spark.createDataFrame([(20, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert hamming_search.search(one, one, 3, 2).count() == 0


def _levels(sizes, weights, budget, cap):
    left, free, out = budget * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def test_mix(docs, rows):
    got = mixing.mix(docs, [3, 1, 2], 1.5, 2.0, 7).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(data.WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = dict(zip(order, _levels([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5, 2)))
    taken, most = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(data.WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-12) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
    same = Counter((r[0], r[1]) for r in rows)
    for s in order:  # whole documents: at most half of the last (with its repeated rows) off
        assert abs(taken[s] - target[s]) <= most[s] * max(same.values()) / 2 + 1e-6
    again = mixing.mix(docs.repartition(2), [3, 1, 2], 1.5, 2.0, 7)
    assert data.multiset(again.collect()) == data.multiset(got)
    assert mixing.repeated_rows(mixing.mix(docs, [3, 1, 2], 1.5, 2.0, 7)).count() == sum(r.copies for r in got)


def test_mix_edges(no_docs, docs, clashing, spark):
    assert mixing.mix(no_docs, [1]).count() == 0
    assert mixing.mix(clashing(docs), [1, 2]).count() == docs.count()
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in mixing.mix(blank, [1]).collect()} == {(0.0, 0)}


def test_mix_has_no_python_in_its_plan(docs):
    plan = mixing.mix(docs, [1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
