"""Tokens, quality rules, main text."""

import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pinax.llm import bpe, html_text, quality
from tests.llm import data

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 11), (100, 20), (40, 6)])
def test_tokens_equal_the_library(docs, rows, chunk, overlap):
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH, PATTERN, chunk=chunk, overlap=overlap), PATH)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    got = both.select("doc_id", F.size("ids"), F.sha2(F.encode(ids, "UTF-8"), 256), F.sha2("bytes", 256))
    assert data.multiset(got.collect()) == data.multiset(data.bpe_reference(rows, PATH, PATTERN))


def test_round_trip_in_one_worker(docs, rows, clashing):
    both = bpe.round_trip(clashing(docs), PATH, PATTERN, chunk=100, overlap=20)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    got = both.select("doc_id", F.size("ids"), F.sha2(F.encode(ids, "UTF-8"), 256), F.sha2("bytes", 256))
    assert data.multiset(got.collect()) == data.multiset(data.bpe_reference(rows, PATH, PATTERN))
    assert "a column" in both.columns and "text" not in both.columns


def test_a_long_text_with_hard_boundaries(spark):
    text = ("a" * 700 + " " * 300 + "don't  we'll" + "\n\n\n   1234567" * 40 + "é" * 500 + "!?" * 200) * 4
    rows = [(1, text), (2, text[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = bpe.decode(bpe.encode(df, PATH, PATTERN, chunk=256, overlap=32), PATH)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    got = both.select("doc_id", F.size("ids"), F.sha2(F.encode(ids, "UTF-8"), 256), F.sha2("bytes", 256))
    assert data.multiset(got.collect()) == data.multiset(data.bpe_reference(rows, PATH, PATTERN))


def _pieces(spark, text, chunk, overlap):
    df = spark.createDataFrame([("k", text)], "_bpe_row string, text string")
    found = bpe._stitched(bpe._chunks(df, "text", chunk, overlap), PATTERN, overlap).collect()
    return [r._piece for r in sorted(found, key=lambda r: r._no)]


def test_chunks_are_stitched_not_joined(spark):
    text = "some plain words, 123 and more. " * 200
    pieces = _pieces(spark, text, 512, 64)
    assert len(pieces) == math.ceil(len(text) / 512) and "".join(pieces) == text


def test_a_broken_chain_goes_on_after_the_break(spark):
    text = "some plain words, 123 and more. " * 100 + "a" * 700 + " " * 2000 + "b" * 90 + " and so on" * 300
    pieces = _pieces(spark, text, 512, 64)
    assert "".join(pieces) == text and len(pieces) >= math.ceil(len(text) / 512) - 6
    found = bpe.pretokens(PATTERN)
    assert [x for p in pieces for x in found(p)] == found(text)


def test_reserved_names_are_refused(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("_bpe_row", F.lit(1)), PATH, PATTERN)
    wide = docs.select("doc_id", "text", F.lit(1).alias("_row"), F.lit(2).alias("_no"))
    assert {"_row", "_no"} < set(bpe.encode(wide, PATH, PATTERN, chunk=100, overlap=20).columns)


def test_bpe_query(spark):
    from pinax.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op1_byte_bpe(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"),
                          ("decoded_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert data.multiset(got.collect()) == data.multiset(data.bpe_reference(rows, PATH, PATTERN))


def test_measures(docs, rows):
    got = quality.measure(docs).select("doc_id", *quality.MEASURES[:5])
    assert data.multiset(got.collect()) == data.multiset(data.measures_reference(rows))


def _thue_morse(n, a, b):
    """A text of n units on which polynomial hashes modulo a power of two cannot tell a from b."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_texts_that_fool_polynomial_hashes(spark):
    rows = []
    for i, n in enumerate((64, 1024, 2048, 8192)):
        one, two = _thue_morse(n, "a", "b"), _thue_morse(n, "b", "a")
        rows.append((i, f"{one}\n{two}\n{one}\n" + f"x {one} y x {two} y x {one} y ", None, None, None))
    got = quality.measure(spark.createDataFrame(rows, data.DOC_SCHEMA)).select("doc_id", *quality.MEASURES[:5])
    assert data.multiset(got.collect()) == data.multiset(data.measures_reference(rows))


def test_numbers_tell_ranges_apart(monkeypatch):
    import numpy as np

    from pinax.llm import common

    r = random.Random(4)
    parts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 2, 7, 8, 9, 600]))) for _ in range(300)]
    parts += parts[:40]
    ends = np.cumsum([len(p) for p in parts])
    starts, raw = ends - [len(p) for p in parts], np.frombuffer(b"".join(parts), np.uint8)
    real = common.range_hashes
    for bits in (64, 9):  # with few bits, different ranges share a hash under most seeds
        monkeypatch.setattr(common, "range_hashes",
                            lambda d, s, e, seed=0: real(d, s, e, seed) >> np.uint64(64 - bits if seed < 3 else 0))
        got = common.numbered(raw, starts, ends).tolist()
        assert [[a == b for b in got] for a in got] == [[a == b for b in parts] for a in parts]
    assert len(common.packed([np.array([1 << 40]), np.array([1 << 22]), np.array([1])])) == 2


def test_quality_reserved_names(docs, labels):
    with pytest.raises(ValueError):
        quality.quality_rules(docs.withColumn("_quality_cut_long_words", F.lit(1)), labels)


def test_binomial_tail_is_exact():
    assert quality.binomial_tail(2 * 10 ** 7, 10 ** 9, 0.02) == pytest.approx(0.5, abs=0.01)
    assert quality.binomial_tail(10 ** 9 - 5, 10 ** 9, 0.02) == 1.0
    for k, n, p in ((0, 10, 0.2), (3, 10, 0.2), (9, 10, 0.9), (10, 10, 0.5), (40, 1000, 0.05)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality.binomial_tail(0, 0, 0.1) == 1.0


def _holdout(spark, rows):
    cols = "lang string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, " \
           "n_repeat_words long, n_lines long"
    return spark.createDataFrame(rows, cols)


def test_cutoffs_are_certified_per_stratum(spark):
    rows = [("en", 1, 100, 500, 0, 0, 0, 10)] * 3000 + [("en", 0, 100, 500, 60, 0, 0, 10)] * 300
    rows += [("de", 1, 100, 500, 0, 0, 0, 10)] * 20 + [("de", 0, 100, 500, 60, 0, 0, 10)] * 20
    rows += [(None, 1, 100, 500, 60, 0, 0, 10)] * 3000 + [(None, 0, 100, 500, 90, 0, 0, 10)] * 9
    rows += [("fr", 1, 100, 500, 0, 0, 0, 10)] * 3000
    cuts = {(r.stratum, r.rule): r for r in
            quality.calibrate(_holdout(spark, rows), "lang", F.col("quality") == 1).collect()}
    assert cuts["en", "symbols_per_word"].cutoff == 0.5  # the most lenient that rejects all bad ones
    assert not any(s == "de" for s, _ in cuts)           # too few labels to certify anything
    assert cuts[None, "symbols_per_word"].cutoff == 0.75  # a stricter one would reject good ones
    assert cuts["fr", "symbols_per_word"].cutoff == 2.0   # no bad ones: the most lenient
    for r in cuts.values():
        level = 0.05 / (len(quality.RULES) * 4)
        assert quality.binomial_tail(r.n_rejected, r.n_good, 0.02 / len(quality.RULES)) <= level


def test_verdicts(docs, labels, rows):
    out = quality.quality_rules(docs, labels)
    assert out.count() == len(rows)
    for r in out.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def _judged_plainly(rows, quality_of, alpha=0.02, delta=0.05):
    """The ids that are kept, from the texts, labels and ``RULES`` alone."""
    of, lang, base = {}, {r[0]: r[2] for r in rows}, set()
    for (i, n, chars, symbols, dup, cover), r in zip(data.measures_reference(rows), rows):
        lines = len([x for x in r[1].split("\n") if x.strip()])
        of[i] = [symbols / n, dup / lines, cover / n, chars / n, -chars / n]
        if n < 50 or 2 * cover > n:
            base.add(i)
    cuts = list(quality.RULES.values())
    order = sorted(((i + 1) / len(c), k, i) for k, c in enumerate(cuts) for i in range(len(c)))
    rejects = lambda i, at: any(of[i][k] > c for k, c in at.items())
    kept, strata = set(of) - base, {lang[i] for i in quality_of if i not in base}
    for s in strata:
        good, bad = ([i for i, q in quality_of.items() if q == want and lang[i] == s and i not in base] for want in (1, 0))
        sets, at = [], {}
        for _, k, i in order:
            at = at | {k: cuts[k][i]}
            x = sum(rejects(d, at) for d in good)
            tail = sum(math.comb(len(good), j) * alpha ** j * (1 - alpha) ** (len(good) - j) for j in range(x + 1))
            if tail > delta / len(strata):
                break
            sets.append((sum(rejects(d, at) for d in bad), at))
        used = next((at for n, at in sets if n == sets[-1][0]), {})
        kept -= {i for i in kept if lang[i] == s and rejects(i, used)}
    return kept


def test_kept_equals_a_plain_version(spark):
    r, rows, quality_of = random.Random(4), [], {}
    for lang, n_good in (("en", 700), ("fr", 260), (None, 217), ("es", 216)):
        for k in range(n_good + 40):
            bad = k >= n_good
            words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(60 if k % 19 else 30)]
            if bad:
                words = [w + "#" * (k % 3) if i % 2 else w * (1 + k % 2) for i, w in enumerate(words)]
            elif lang == "en" and k % 200 == 1:
                words[:40] = ["#&" + w for w in words[:40]]  # good ones that some rule sets reject
            rows.append((len(rows), "\n".join(" ".join(words[i:i + 10]) for i in range(0, len(words), 10)), lang, None, 1))
            if k % 10:
                quality_of[len(rows) - 1] = int(not bad)
    for lang in ("fr", None):  # more good labels past the base rules
        rows += [(len(rows) + k, " ".join(["plain", "words"][k % 2] + str(i) for i in range(60)), lang, None, 1)
                 for k in range(60)]
        quality_of |= {row[0]: 1 for row in rows[-60:]}
    docs = spark.createDataFrame(rows, data.DOC_SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality_of.items()], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.quality_rules(docs, labels).filter("kept").collect()}
    assert kept == _judged_plainly(rows, quality_of)
    lost = {lang: sum(x[2] == lang and x[0] not in kept and len(x[1].split()) >= 50 for x in rows)
            for lang in ("en", "fr", None, "es")}
    assert lost["fr"] > 0 and lost[None] > 0 and lost["en"] > 0 and lost["es"] == 0


def test_quality_edges(no_docs, docs, labels, clashing):
    assert quality.quality_rules(no_docs, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).filter("kept <> (not base_failed)").count() == 0
    out = quality.quality_rules(clashing(docs), labels)
    assert out.count() == docs.count() and len({c.lower() for c in out.columns}) == len(out.columns)


def test_bpe_edges(no_docs, docs, clashing):
    assert bpe.decode(bpe.encode(no_docs, PATH, PATTERN), PATH).count() == 0
    assert bpe.decode(bpe.encode(clashing(docs), PATH, PATTERN), PATH).count() == docs.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, really, on this site, for you.</p></div>
<div id="page"><div class="sidebar"><p><a href="/x">Related, one</a></p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph,\n with &eacute; and&nbsp;a <a href="/l">link</a>, more.<br>next
<p>Second <b>bold</b> one, long enough to count, with commas, and text.</p>
<form><input name="q"><p>Search here, please.</p></form><!-- no -->
<ul><li>an item</li><li>another</ul>
<div class="ad">Buy, buy, buy.</div></article>
<div class="comments"><p>Nice article, thanks, reader.</p></div></div>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head & line", "First paragraph, with é and a link, more. next",
        "Second bold one, long enough to count, with commas, and text.", "an item", "another"]


def test_siblings_of_the_best_container_are_kept():
    para = "<p>" + "Some words, and more words, of a story that goes on. " * 4 + "</p>"
    html = f"<body><div><section>{para * 3}</section><section>{para}</section><div><a href=x>a link</a></div></div></body>"
    assert len(html_text.main_text(html).split("\n")) == 4


def test_an_article_is_not_cut_to_its_longest_part():
    para = "<p>" + "Some words, and more words, of a story that goes on. " * 4 + "</p>"
    article = f"<article><h1>Title</h1><section>{para * 9}</section><section><p>Short end.</p></section></article>"
    body = f"<main><h2>Site</h2>{article}<div class='user-comments'>{para * 20}</div><aside>{para}</aside></main>"
    lines = html_text.main_text(f"<body>{body}</body>").split("\n")
    assert lines[0] == "Title" and lines[-1] == "Short end." and len(lines) == 11
    plain = f"<body><div><h1>Title</h1><section>{para * 9}</section><ul><li><a href=x>more</a></li></ul></div></body>"
    assert len(html_text.main_text(plain).split("\n")) == 10


STORY = "<p>Some words, and more words, of a story that goes on.</p>"


@pytest.mark.parametrize("start", ["<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title>",
                                   "<head><title>T</title><noscript><style>p{}</style><body>"])
def test_a_head_without_an_end_tag(start):
    assert html_text.main_text(f"{start}{STORY * 2}").count("story") == 2
    assert html_text.main_text("<head><title>T</title>Plain text.") == "Plain text."


@pytest.mark.parametrize("wrap", ["class='layout has-sidebar'", "class='page no-sidebar'", "class='post-content comments-open'",
                                  "class='header-fixed wrapper'", "id=discussion", "class=widget"])
def test_a_wrapper_named_like_furniture_keeps_the_page(wrap):
    rest = "<div class=sidebar><p>Some offers, here.</p></div>"
    for inner in (f"<article>{STORY * 4}</article>", STORY * 4, f"<form action=x>{STORY * 4}</form>"):
        assert html_text.main_text(f"<body><div {wrap}>{inner}{rest}</div></body>").split("\n") == [
            "Some words, and more words, of a story that goes on."] * 4
    assert "offers" not in html_text.main_text(f"<body><form id=aspnet>{STORY * 4}{rest}</form></body>")


def test_sections_and_headings_are_not_furniture_by_their_id():
    html = (f"<main><h1 id=related>Title</h1><section id=results><h2>Results</h2>{STORY * 3}</section>"
            f"<section id=discussion><h2>Discussion</h2>{STORY * 2}</section>"
            f"<section id=comments><h2>Comments</h2>{STORY}</section></main>")
    text = html_text.main_text(f"<body><article>{html}</article></body>")
    assert "Title" in text and "Discussion" in text and text.count("story") == 5


@pytest.mark.parametrize("around", ["<main>{}</main>", "<div id=content>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>",
                                    "<main><div id=content>{}</div></main>"])
@pytest.mark.parametrize("part", ["<section>{}</section>", "<div><section>{}</section></div>"])
def test_short_parts_beside_a_long_one_are_kept(around, part):
    long = "<p>" + "Some words, and more words, of a story that goes on. " * 4 + "</p>"
    say = lambda x: part.format(f"<p>{x}</p>")
    inner = (f"<h1>Title</h1>bare{say('Intro')}{part.format(long * 30)}<ul><li>one<li>two</ul><table><tr><td>cell</table>"
             f"<blockquote>Quote</blockquote><pre>code</pre>{say('The end')}")
    lines = html_text.main_text(f"<body><nav>no</nav>{around.format(inner)}<ul><li><a href=x>more</a></ul></body>").split("\n")
    assert len(lines) == 39 and lines[:3] == ["Title", "bare", "Intro"]
    assert lines[33:] == ["one", "two", "cell", "Quote", "code", "The end"]


@pytest.mark.parametrize("html", ["", None, "plain", "<p>", "</div></p>", "<div>" * 3000 + "deep", "<a href='x'>only</a>",
                                  "<script>alert(1)", "<p>&#0;&#xD800;&bogus;</p>", "<", "<!--", "<![CDATA[x]]>"])
def test_broken_pages(html):
    text = html_text.main_text(html)
    assert text == text.strip() and "alert" not in text


def test_extract(spark, clashing):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in got].count((2, 0)) == 1
    assert all(len(r.text) == r.n_chars for r in got)
    assert html_text.extract(clashing(df)).count() == 3 and html_text.extract(df.limit(0)).count() == 0


MARKUP = ["<div>", "</div>", "<div class=content>", "<div class='sidebar ad'>", "<p>", "</p>", "<article>", "</article>",
          "<main>", "</main>", "<section id=comments>", "<section id=intro>", "<h2>Intro</h2>", "</section>", "<ul><li>",
          "<li>", "</ul>", "<a href=x>", "</a>", "<table><tr><td>", "</table>", "<form>", "</form>", "<nav>", "</nav>",
          "<header>", "</header>", "<body>", "<head>", "<br>", "<span>", "</span>", "<template>", "</template>", "<title>",
          "</title>", "<!-- c -->", "<b>", "<script>if (a<b) {}</script>", "<blockquote>", "</blockquote>", "<td>", "</h1>"]
ODD = ["<!--", "-->", "<!-->", "<![foo[bar]]>", "<![CDATA[x]]>", "<![if !IE]>", "<!", "<?", "<?php x ?>", "</", "<", ">", "&",
       "&#0000000000065;", "&#" + "9" * 5000 + ";", "&#xFFFFFFFFFF;", "&#" + "0" * 5000 + "66;", "&amp", "&notit;", "<a <b>",
       "<div class=", "<div class='", "<!DOCTYPE", "<!ELEMENT x>", "</div", "<script>", "<style>", "<textarea>", "\x00", "é",
       "<svg><title>x</svg>", "<![", "<!-", "--!>", "]]>", "<p/>", "<br/>", "</br>", "</p>"]


def _random_page(r, odd):
    say = lambda: " ".join(r.choice(["word", "and", "so,", "long" * 5]) for _ in range(r.randint(0, 25)))
    return "".join(r.choice(MARKUP + (ODD if odd else [])) + (say() if r.random() < 0.6 else "")
                   for _ in range(r.randint(0, 60)))


def test_main_text_against_plain_walks():
    from tests.llm import plain_html

    r = random.Random(11)
    for _ in range(1500):
        page = _random_page(r, odd=False)
        assert html_text.main_text(page) == plain_html.main_text(page), page


def test_no_page_stops_the_job():
    r = random.Random(12)
    for _ in range(4000):
        html_text.main_text(_random_page(r, odd=True))
    for _ in range(2000):
        html_text.main_text("".join(r.choice("<>!-[]&#x;'\"/ =adivp0") for _ in range(r.randint(0, 80))))
    assert html_text.main_text("<body><![foo[bar]]><p>text</p>") == "text"
    assert html_text.main_text(f"<p>a &#{'9' * 5000}; &#{'0' * 5000}66; &#xFFFFFFFFFF;</p>") == "a \ufffd B \ufffd"


def test_what_the_page_end_cuts_off_is_no_text():
    for rest in ("<!-- hidden note", "<!hidden", "<?hidden", "</hidden", "<div class='hidden", "<![CDATA[hidden"):
        assert html_text.main_text(f"<body><div><p>seen</p></div>{rest}") == "seen"
    assert html_text.main_text("<p>a <!--> b <!---> c <!-- no --!> d</p> 1 < 2") == "a b c d\n1 < 2"


def test_an_article_keeps_its_own_header():
    page = "<body><header>Site</header><article><header><h1>Title</h1><p>Lead</p></header><p>Story.</p></article></body>"
    assert html_text.main_text(page).split("\n") == ["Title", "Lead", "Story."]


def test_main_text_is_linear():
    import time

    n = 100_000
    pages = ["<div>x" * n, "<div>" * n + "</section>" * n, "<p><nav><div>" + "<ul>" * n + "</p>" * n,
             "<div>" * n + "<body>" * n, "<div class=sidebar>a b c</div><div class=content>d</div>" * (n // 2),
             "<article>x" * (n // 2)]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 20


def test_main_text_query(spark):
    from pinax.llm import queries
    from tests.llm import plain_html

    sf = "/root/testdata/sf0.001"
    got = queries.op10_main_text(spark, sf)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(r.page_id, r.url, plain_html.main_text(r.html), len(plain_html.main_text(r.html)))
            for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert data.multiset(got.collect()) == data.multiset(want)
