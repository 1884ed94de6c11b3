"""Registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, hamming_search, html_text, licenses, mixing, phrases, quality, rlz, shards, simhash, suffixes, urls
from ..session import checkpoint_dir
from .common import WORD, table

VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed rules of the url query.
URL_RULES = [
    urls.Rule("net", "/", allow=False),
    urls.Rule("example.net", "/en/", allow=True),
    urls.Rule("example.com", "/de/", allow=False),
    urls.Rule("org", "/fr/", allow=True),
]
N_SHARDS = 40
SEARCH_K = 10
MIX_WEIGHTS = [3, 1, 2]
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 1.5, 2.0, 20240501

#: Seed, share of texts that are transformed and share of those with the suffix first, in per cent.
FIM = ("7", 100, 50)

PHRASES = {"min_count": 30, "top": 2000, "scale": 2_000_000, "covered_percent": 80}


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(VOCABULARY)
    both = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A run of its own: version 1 is stored, loaded, edited, and version 2 places the records.
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pinax-llm/slot-map-{uuid.uuid4().hex}"
    placed, _ = shards.shard(table(spark, sf_dir, "documents"), N_SHARDS, folder=folder)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, window=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming_search.search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=SEARCH_K, bits=64)


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), " ")
    return rlz.remove_repeats(docs, window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
            .select("page_id", "url", "text", "n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), *FIM)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), **PHRASES)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _license_sql() -> str:
    """The same by regular expressions over the words, each followed by a blank."""
    found = ", ".join(f"CASE WHEN regexp_matches(line, '{licenses.pattern(t.wording)}') THEN {no} END"
                      for no, t in enumerate(licenses.TEMPLATES))
    known = ", ".join(f"({no}, '{t.label}', {f"'{t.of}'" if t.of else 'NULL'})"
                      for no, t in enumerate(licenses.TEMPLATES))
    places = "\n  UNION ALL ".join(
        f"SELECT doc_id, '{p.label}' AS label, unnest(list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.wording.split(), 1)) + ")) AS place FROM split"
        for p in licenses.PHRASES)
    return rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lined AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM split),
places AS (
  {places}),
known(no, label, confirms) AS (VALUES {known}),
accepted AS (SELECT doc_id, unnest(list_filter([{found}], lambda x: x IS NOT NULL)) AS no FROM lined),
sure AS (SELECT doc_id, label FROM accepted JOIN known USING (no)
         UNION SELECT doc_id, confirms FROM accepted JOIN known USING (no) WHERE confirms IS NOT NULL),
labelled AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM accepted JOIN known USING (no)),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
judged AS (SELECT l.doc_id, string_agg(l.label, ',' ORDER BY l.label) AS labels,
                  CAST(count(*) + count(s.label) AS DOUBLE) / CAST(2 * count(*) AS DOUBLE) AS score
           FROM labelled l LEFT JOIN sure s ON s.doc_id = l.doc_id AND s.label = l.label GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN judged USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_virtual_slots, op3_suffix_dedup, op4_url_filter, op5_quality_rules,
                            op6_hamming_top_k, op7_rlz_dedup, op8_mix_sources, op9_simhash, op10_main_text, op11_fill_in_middle, op12_phrase_mining,
                            op13_license_scan)}

ORACLE: dict[str, str] = {
    "op12_phrase_mining": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY 1),
places AS (
  SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: w[i + 1:i + k])) AS ws
  FROM split, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
found AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM places GROUP BY 1, 2, 3
          HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, ws, f AS a, k, unnest(range(1, k)) AS j FROM found WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, c.j,
         CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.j], ' ')
  JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
  SELECT lang, f, array_to_string(ws[b + 1:b + n], ' ') AS phrase FROM (
    SELECT lang, f, ws, n, unnest(range(k - n + 1)) AS b FROM found, (VALUES (2), (3)) AS s(n) WHERE k > n)),
longer AS (SELECT lang, phrase, max(f) AS f FROM parts GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase
         WHERE o.f IS NULL OR CAST(100 AS HUGEINT) * o.f < CAST(80 AS HUGEINT) * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_license_scan": _license_sql(),
    "op11_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || hx[1:8] AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || hx[9:16] AS BIGINT) % (len(u) + 1) AS h2,
         CAST('0x' || hx[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || hx[25:32] AS BIGINT) % 100 AS h4 FROM units),
cut AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                                 OR contains(text, '<M>') OR h3 >= 100 THEN 'plain'
                               WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1, h2)], '') AS p,
         array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
         array_to_string(u[greatest(h1, h2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut""",
    "op6_hamming_top_k": f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
         CAST(len(list_filter(list_zip(list_transform(q.embedding, lambda x: x > 0),
                                       list_transform(r.embedding, lambda x: x > 0)),
                              lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank,
         neighbour_id, distance FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= {SEARCH_K}""",
    "op4_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
