"""Column expressions for cleaning text cells (built-in Spark functions only).

Every function takes and returns a ``Column``; nothing here leaves the JVM.
Regex patterns are Java patterns.  Patterns that are written in the style of
an engine whose ``.`` stops only at ``\\n`` get the ``(?d)`` (UNIX_LINES) flag
so that Java's ``.`` behaves the same, and ``\\z`` is used for "end of text"
because Java's ``$`` also matches before a final line break.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode White_Space code points (the characters a plain "strip whitespace"
# removes): TAB..CR, NEXT LINE, and every character of general category Z.
WHITE_SPACE_CLASS = r"\x09-\x0D\x85\p{Z}"
# Characters a Python ``str.isspace()`` accepts: White_Space plus the four
# information separators U+001C..U+001F.
PY_SPACE_CLASS = r"\x09-\x0D\x1C-\x1F\x85\p{Z}"
# Letters and numbers (Python ``str.isalnum()``).
ALNUM_CLASS = r"\p{L}\p{N}"
# A plain decimal number, optional sign and exponent; what a lenient cast accepts.
DECIMAL_BODY = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
# Anything outside 7-bit ASCII.
NON_ASCII = r"[^\x00-\x7F]"
# (Class strings use only \xhh escapes so Java, RE2 and Python all read them.)
# ---------------------------------------------------------------------------

DECIMAL_PATTERN = "^" + DECIMAL_BODY + r"\z"

# White_Space as a literal set of characters, for btrim (no regex needed);
# derived from the class above (all White_Space code points are below U+3001).
_WS_RE = regex.compile(f"[{WHITE_SPACE_CLASS}]")
_WS_CHARS = "".join(chr(c) for c in range(0x3001) if _WS_RE.match(chr(c)))


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing Unicode whitespace.

    ``trim`` only removes ASCII spaces; ``btrim`` with the full White_Space set
    also removes tabs, no-break spaces and the other Z characters.
    """
    return F.btrim(col_of(c), F.lit(_WS_CHARS))


def lenient_double(c: str | Column, thousands_sep: str | None = None) -> Column:
    """String to double where text that is not a plain decimal number gives null.

    ``try_cast`` alone accepts Spark literals such as ``1.0d`` or ``1f``; the
    regex guard keeps only plain decimals.  ``thousands_sep`` removes a grouping
    character first (``1,234`` -> ``1234``).
    """
    s = strip_ws(col_of(c).cast("string"))
    if thousands_sep:
        s = F.replace(s, F.lit(thousands_sep), F.lit(""))
    return F.when(s.rlike(DECIMAL_PATTERN), s.try_cast("double"))


def name_rule(c: str | Column) -> Column:
    """The column-name rule applied to text values.

    Keep letters, numbers and whitespace -> lower case -> whitespace runs to
    ``_`` -> drop non-ASCII.  The order matters: ``_`` itself is removed in
    the first step, and non-ASCII letters survive until the last.
    """
    kept = F.regexp_replace(col_of(c), f"[^{ALNUM_CLASS}{PY_SPACE_CLASS}]", "")
    under = F.regexp_replace(F.lower(kept), f"[{PY_SPACE_CLASS}]+", "_")
    return F.regexp_replace(under, NON_ASCII, "")


def replace_all(c: str | Column, pattern: str, replacement: str) -> Column:
    """Regex replace of every match, ``.`` stopping only at ``\\n`` (D3)."""
    return F.regexp_replace(col_of(c), "(?d)" + pattern, replacement)


def drop_trailing_marker(c: str | Column) -> Column:
    """Drop a final ``<space><one character>`` such as ``Name †``."""
    return F.regexp_replace(col_of(c), r"(?d) .\z", "")


def replace_chars(c: str | Column, mapping: dict[str, str]) -> Column:
    """Literal one-to-one character replacement (D5), e.g. ``{"\\351": "é"}``.

    One ``translate`` pass instead of one regex replace per character.  For
    text that was decoded with the wrong charset, decode it right instead
    (``sources.files.read_csv(encoding=...)``).
    """
    if any(len(k) != 1 or len(v) != 1 for k, v in mapping.items()):
        raise ValueError("replace_chars maps single characters to single characters")
    return F.translate(col_of(c), "".join(mapping), "".join(mapping.values()))


def contains(c: str | Column, pattern: str) -> Column:
    """Unanchored regex test (C1); null in, null out."""
    return col_of(c).rlike("(?d)" + pattern)


def recode(df: DataFrame, col: str, rules: list[tuple[str, str]], to: str | None = None) -> DataFrame:
    """Ordered conditional recode (D6): each rule sees the previous rule's output.

    ``rules`` is a list of ``(regex, value)``.  A value matching rule i is
    replaced by the literal of rule i, otherwise kept; the result is in ``to``
    (default: in place).  One projection per rule: as one expression, every
    rule would hold the rules before it twice and its size would double.
    """
    to = to or col
    out = df if to == col else df.withColumn(to, F.col(col))
    for pattern, value in rules:
        out = out.withColumn(to, F.when(contains(to, pattern), F.lit(value)).otherwise(F.col(to)))
    return out


def class_expr(c: str | Column, rules: list[tuple[str, str]], default: str,
               null_class: str | None = "null") -> Column:
    """First-match classification (C7): ``rules`` is ``[(class, regex), ...]``.

    Null values get ``null_class`` so no row silently falls out of every class.
    """
    col = col_of(c)
    out = F.when(col.isNull(), F.lit(null_class))
    for name, pattern in rules:
        out = out.when(contains(col, pattern), F.lit(name))
    return out.otherwise(F.lit(default))
