"""Tables and list links from a table of web pages.

Input: a DataFrame ``(page_id, html)`` (for instance the ``pages`` table).
Tables nest, so each task parses its own pages with the standard-library
``html.parser`` (``mapInPandas``), in batches of bounded size; everything after the parse
(choosing a table by ordinal, reading the header, picking a column) is ordinary
DataFrame work.  Links need no tree and are found by built-in expressions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SCHEMA = ("page_id long, table_idx int, rows array<struct<is_header: boolean, cells: array<string>>>, "
                "error string")

_SPACES = re.compile(r"\s+")


def _text(parts: list[str]) -> str:
    return _SPACES.sub(" ", "".join(parts)).strip()


class _PageParser(HTMLParser):
    """One pass over a page: table rows in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, bool, list[str]]] = []
        self._n_tables = 0
        self._tables: list[dict] = []  # stack of open tables

    # -- tables --------------------------------------------------------------
    def _open_table(self):
        self._tables.append({"idx": self._n_tables, "row": -1, "cells": None,
                             "kinds": None, "cell": None, "span": 1, "down": {}})
        self._n_tables += 1

    def _close_cell(self, t):
        if t["cell"] is not None:
            text = _text(t["cell"])
            col = len(t["cells"])
            # fill columns still covered by a rowspan from an earlier row
            while col in t["down"]:
                col = self._fill_down(t, col)
            t["cells"].extend([text] * t["span"])
            t["kinds"].extend([t["kind"]] * t["span"])
            if t["rowspan"] > 1:
                for k in range(col, col + t["span"]):
                    t["down"][k] = [text, t["rowspan"] - 1, t["kind"]]
            t["cell"] = None

    def _fill_down(self, t, col):
        text, left, kind = t["down"][col]
        t["cells"].append(text)
        t["kinds"].append(kind)
        if left <= 1:
            del t["down"][col]
        else:
            t["down"][col][1] = left - 1
        return col + 1

    def _close_row(self, t):
        self._close_cell(t)
        if t["cells"] is not None:
            while len(t["cells"]) in t["down"]:
                self._fill_down(t, len(t["cells"]))
            header = bool(t["kinds"]) and all(k == "th" for k in t["kinds"])
            self.rows.append((t["idx"], t["row"], header, t["cells"]))  # an empty row keeps its place
            t["cells"] = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self._open_table()
        elif self._tables:
            t = self._tables[-1]
            if tag == "tr":
                self._close_row(t)
                t["row"] += 1
                t["cells"], t["kinds"] = [], []
            elif tag in ("td", "th"):
                if t["cells"] is None:      # cell without <tr>
                    t["row"] += 1
                    t["cells"], t["kinds"] = [], []
                self._close_cell(t)
                t["cell"], t["kind"] = [], tag
                t["span"] = _int(a.get("colspan"))
                t["rowspan"] = _int(a.get("rowspan"))

    def handle_endtag(self, tag):
        if tag == "table" and self._tables:
            self._close_row(self._tables.pop())
        elif self._tables:
            t = self._tables[-1]
            if tag in ("td", "th"):
                self._close_cell(t)
            elif tag == "tr":
                self._close_row(t)

    def handle_data(self, data):
        if self._tables and self._tables[-1]["cell"] is not None:
            self._tables[-1]["cell"].append(data)


def _int(v) -> int:
    try:
        return max(1, int(v))
    except (TypeError, ValueError):
        return 1


def _parse(html):
    p = _PageParser()
    p.feed(html or "")
    p.close()
    for t in reversed(p._tables):   # unclosed tables at end of page
        p._close_row(t)
    return p


#: Characters of pages whose tables make one batch; a longer page is a batch of its own.
BATCH_CHARS = 1 << 20


def _table_batches(batches):
    columns = ["page_id", "table_idx", "rows", "error"]
    for pdf in batches:
        out, held = [], 0
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            held += len(html or "")
            try:
                tables: dict[int, list] = {}
                for t, r, h, cells in _parse(html).rows:
                    tables.setdefault(t, []).append((r, {"is_header": h, "cells": cells}))
                out += [(pid, t, [x for _, x in sorted(rows, key=lambda x: x[0])], None) for t, rows in tables.items()]
            except Exception as e:  # malformed page: one error row, job goes on
                out.append((pid, None, None, repr(e)))
            if held >= BATCH_CHARS:
                yield pd.DataFrame(out, columns=columns)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, table_idx, rows, error)``: each ``<table>`` of each page with its rows.

    ``table_idx`` counts ``<table>`` elements in document order from 0, as a
    list of all tables would; ``colspan`` / ``rowspan`` repeat the cell text.
    Filter the pages before this step: only what is left is parsed.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return src.mapInPandas(_table_batches, TABLE_SCHEMA)


def html_cells(tables: DataFrame) -> DataFrame:
    """``(page_id, table_idx, row_idx, is_header, cells)`` for every row of ``html_tables``."""
    return (tables.filter(F.col("error").isNull())
            .select("page_id", "table_idx", F.posexplode("rows").alias("row_idx", "r"))
            .select("page_id", "table_idx", "row_idx", "r.is_header", "r.cells").filter(F.size("cells") > 0))


#: Named character references, beside those by number, that ``list_links`` decodes.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "eacute": "é", "egrave": "è", "ecirc": "ê",
            "euml": "ë", "agrave": "à", "acirc": "â", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ccedil": "ç",
            "ocirc": "ô", "ucirc": "û", "ugrave": "ù", "icirc": "î", "iuml": "ï", "Eacute": "É", "Auml": "Ä", "Ouml": "Ö",
            "Uuml": "Ü", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "laquo": "«",
            "raquo": "»", "hellip": "…", "euro": "€", "copy": "©", "dagger": "†"}
#: What is no part of a list: comments, scripts, styles.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: From an item's start tag to the next item's, or to the start or end of a list.
_ITEM = r"(?is)<li\b" + _TAG + r"(.*?)(?=</?li\b|</?[ou]l\b|\z)"
#: A link's attributes, and what stands up to its end.
_LINK = r"(?is)<a(?=[\s/])(" + _TAG + r")(.*?)(?=</a\b|<a[\s/]|\z)"
#: Its address, in quotes or without.
_HREF = r"""(?is)(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def list_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, pos, href, text)`` for each link in a list item, in page order.

    Items are taken first, without comments, scripts and styles; then every link
    of an item, wherever it stands in it, whether its address is in quotes or
    not.  Built-in expressions only.  Character references by number and those
    in ``ENTITIES`` are decoded; tags inside the link are dropped.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"),
                       F.regexp_replace(html_col, _HIDDEN, "").alias("html"))
    def links(item):
        found = lambda g: F.regexp_extract_all(item, F.lit(_LINK), F.lit(g))
        return F.arrays_zip(found(1).alias("tag"), found(2).alias("text"))

    items = F.regexp_extract_all("html", F.lit(_ITEM), F.lit(1))
    every = F.filter(F.flatten(F.transform(items, links)), lambda x: x["tag"].rlike(_HREF))
    each = src.select("page_id", F.posexplode(every).alias("pos", "a"))
    href = F.concat(*[F.regexp_extract("a.tag", _HREF, g) for g in (1, 2, 3)])
    text = F.regexp_replace(decoded(F.regexp_replace("a.text", "<[^>]*>", "")), r"\s+", " ")
    return each.select("page_id", (F.col("pos") + 1).alias("pos"), F.trim(decoded(href)).alias("href"),
                       F.trim(text).alias("text"))


def decoded(c):
    """The text with its character references decoded, each once, by a look-up."""
    known = F.create_map(*[F.lit(x) for pair in (ENTITIES | {"amp": "&"}).items() for x in pair])
    parts = F.split(c, "&")

    def char(name):
        number = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(
            name.rlike("^#[0-9]{1,7}$"), F.substr(name, F.lit(2))).cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        # A code point as four bytes, read back as text.
        by_number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))
        return F.coalesce(by_number, F.try_element_at(known, name))

    def part(x):
        name = F.substring_index(x, ";", 1)
        found = F.when(F.contains(x, F.lit(";")), char(name))
        return F.coalesce(F.concat(found, F.substr(x, F.char_length(name) + 2)), F.concat(F.lit("&"), x))

    first = F.element_at(parts, 1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), part)
    return F.when(F.size(parts) > 1, F.concat(first, F.array_join(rest, ""))).otherwise(c)


def subpages(rows: DataFrame, id_col: str, order_col: str, row_html: Column, head: str, foot: str,
             rows_per_page: int = 1000) -> DataFrame:
    """``(page_id, part, html)``: rows written as page tables of bounded size, each with the header ``head``.

    A page is split into parts of about ``rows_per_page`` rows by the hash of
    ``order_col``, and each part keeps the header; so a page with a third of all
    rows is made by many groups, and parsed by many tasks.
    """
    o = rows.select(F.col(id_col).alias("page_id"), F.col(order_col).alias("__o"), row_html.alias("__h"))
    parts = o.groupBy("page_id").agg(F.ceil(F.count("*") / rows_per_page).alias("__parts"))
    dealt = o.join(parts, "page_id").withColumn("part", F.pmod(F.xxhash64("__o"), F.col("__parts")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("__o", "__h"))), lambda x: x["__h"])
    return dealt.groupBy("page_id", "part").agg(
        F.concat(F.lit(head), F.array_join(body, ""), F.lit(foot)).alias("html"))


def table_rows(tables: DataFrame, table_idx: int, header_rows: int = 1) -> DataFrame:
    """Rows of the ``table_idx``-th table of each page with their header.

    The deepest of the first ``header_rows`` rows names the columns (a
    two-level header is flattened to its lower level); it lies in the same row
    of ``html_tables`` and is carried along, so a page is parsed once.  Output
    ``(page_id, row_idx, header, cells)``; pick a column with ``column``.
    """
    t = tables.filter((F.col("table_idx") == table_idx) & F.col("error").isNull())
    header = F.try_element_at("rows", F.lit(header_rows))["cells"]
    return (t.select("page_id", header.alias("header"), F.posexplode("rows").alias("row_idx", "r"))
            .filter((F.col("row_idx") >= header_rows) & (F.size("r.cells") > 0))
            .select("page_id", "row_idx", "header", F.col("r.cells").alias("cells")))


def columns(rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``(page_id, row_idx, <name>...)``: for each ``name: (header text, occurrence)`` the cell
    under the ``occurrence``-th header equal to the text.

    ``occurrence=2`` is what a frame library calls ``Name.1`` after it renames
    duplicated headers.  Positions are found per page with array functions, so
    pages with different layouts each get their own column.
    """
    def cell(text: str, occurrence: int):
        at = F.filter(F.sequence(F.lit(1), F.size("header")),
                      lambda i: F.element_at(F.col("header"), i) == F.lit(text))
        return F.try_element_at(F.col("cells"), F.try_element_at(at, F.lit(occurrence)))

    return rows.select("page_id", "row_idx", *[cell(*w).alias(n) for n, w in wanted.items()])


def column(rows: DataFrame, name: str, occurrence: int = 1) -> DataFrame:
    """One column of ``columns``, under its header text."""
    return columns(rows, {name: (name, occurrence)})
