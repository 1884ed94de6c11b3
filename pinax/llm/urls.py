"""URL filter by a Bloom filter cascade (operator 4).

Rules name a host (with its subdomains) and a path prefix.  For each url the
keys that could be listed are written down: every dot suffix of its host with
every prefix of its path that has the length of some rule's path.  A cascade of
Bloom filters then says exactly which of these keys are listed, without a join:
the first level encodes the listed keys, the second the corpus's keys that
wrongly pass the first, the third the listed keys that wrongly pass the second,
and so on until a level lets no wrong key of the corpus pass.  The first level
has so many bits for a listed key that about as many wrong keys pass as are
listed, however large the corpus; so every level is as bounded as the rules,
which the caller holds in a list.

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule.  Repeated rows are judged alike.  Rules may be of one kind only, or
none; a rule listed both ways allows.  An empty table gives no rows.  Input
columns that carry an output's name are replaced, and names that start with
``_url_`` are reserved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reserved, without

#: Bits for each key of the levels after the first, and for each listed key of the first at most.
BITS_PER_KEY, MOST_BITS_PER_KEY = 12, 96
#: Wrong keys for each listed one, at most, that may pass the first level before it is built again with more bits.
MOST_WRONG = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; ``allow`` or block."""

    host: str
    path: str
    allow: bool

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys under which a url could be listed, the longest first.

    A key is a host suffix, a tab and a path prefix; neither part's end is then
    in doubt.  Only path lengths that some rule has are written down."""
    labels = F.split(host, r"\.")
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
                        lambda p: p.isNotNull())
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\t"), p))))
    longest = F.transform(keys, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(longest), lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]  # bits, 64 to a word
    seed: int
    hashes: int

    def bit(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(64 * len(self.words)).cast("long"))

    def passes(self, key: Column) -> Column:
        # One literal, which Spark folds into an array of longs when it plans the query.
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<long>")
        out = F.lit(True)
        for i in reversed(range(self.hashes)):
            at = self.bit(key, i)
            word = F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int"))
            out = F.when(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1, out).otherwise(F.lit(False))
        return out


def _level(keys: DataFrame, n: int, bits_per_key: int, seed: int) -> Level:
    """A filter of the ``n`` keys: its words are an aggregate of bounded size."""
    size = max(1, math.ceil(n * bits_per_key / 64))
    level = Level((0,) * size, seed, max(1, round(bits_per_key * math.log(2) / 2)))
    at = F.explode(F.array(*[level.bit(F.col("key"), i) for i in range(level.hashes)]))
    words = (keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits")))
    found = dict(words.collect())  # at most ``size`` rows
    return Level(tuple(found.get(i, 0) for i in range(size)), seed, level.hashes)


class Cascade:
    """Exact membership of keys of a known universe in a listing."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_universe: int):
        """``listed`` has distinct ``key``; ``universe`` has every ``key`` that will be asked, ``n_universe`` at most.

        Only keys that pass a level go on to the next; they are made distinct
        after that, so what is shuffled are a level's false positives.
        """
        self.levels: list[Level] = []
        n_listed = listed.count()
        if not n_listed:
            return
        # With b bits and b ln(2) / 2 hashes for a key, about one wrong key in e ** (0.42 b) passes.
        bits = BITS_PER_KEY + math.ceil(2.4 * math.log(max(1.0, n_universe / n_listed)))
        inside, outside, n_in = listed, universe, n_listed
        while True:
            first = not self.levels
            level = _level(inside, n_in, min(bits, MOST_BITS_PER_KEY) if first else BITS_PER_KEY, len(self.levels))
            wrong = outside.filter(level.passes(F.col("key")))
            if first:
                wrong = wrong.distinct().join(listed, "key", "left_anti")
            n_wrong = wrong.count()
            if first and n_wrong > MOST_WRONG * n_listed and bits < MOST_BITS_PER_KEY:
                bits *= 2
                continue
            self.levels.append(level)
            if not n_wrong:
                return
            # The keys let through wrongly are encoded next; the roles change.
            inside, outside, n_in = wrong, inside, n_wrong

    def has(self, key: Column) -> Column:
        """Passed by an odd number of levels in a row: listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``.

    A url that fits no rule is not listed, which the cascade shows, and allowed.
    """
    pages = without(reserved(pages, "_url_"), ["host", "path", "rule", "verdict"])
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    parts = (pages.withColumn("host", host_of(url_col)).withColumn("path", path_of(url_col)))
    keyed = parts.withColumn("_url_keys", keys_of(F.col("host"), F.col("path"), lengths) if rules
                             else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("_url_keys").alias("key"))
    n_universe = keyed.agg(F.sum(F.size("_url_keys"))).first()[0] or 0

    def listing(allow: bool) -> DataFrame:
        found = sorted({(f"{r.host}\t{r.path}",) for r in rules if r.allow == allow})
        return spark.createDataFrame(found, "key string")

    block, allow = (Cascade(listing(kind), universe, n_universe) for kind in (False, True))
    looked = F.transform("_url_keys", lambda k: F.struct(k.alias("key"), allow.has(k).alias("allow"),
                                                         block.has(k).alias("block")))
    fits = F.try_element_at(F.filter(looked, lambda x: x["allow"] | x["block"]), F.lit(1))
    verdict = F.when(F.col("_url_fit").isNull() | F.col("_url_fit.allow"), F.lit("allow")).otherwise(F.lit("block"))
    return (keyed.withColumn("_url_fit", fits)
            .withColumn("rule", F.replace(F.col("_url_fit.key"), F.lit("\t"), F.lit("")))
            .withColumn("verdict", verdict).drop("_url_keys", "_url_fit"))
