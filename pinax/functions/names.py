"""Column-name rule for DataFrame metadata (B1/B2).

Column names live on the driver, so the rule runs as plain Python on the list
of names; the same character classes as the row version in ``text.name_rule``
are used (through the ``regex`` module, which understands ``\\p{..}``), so a
header cell and a column name normalise identically.
"""

from __future__ import annotations

import regex

from .text import ALNUM_CLASS, NON_ASCII, PY_SPACE_CLASS

_DROP = regex.compile(f"[^{ALNUM_CLASS}{PY_SPACE_CLASS}]")
_SPACES = regex.compile(f"[{PY_SPACE_CLASS}]+")
_NON_ASCII = regex.compile(NON_ASCII)


def clean_name(name: str) -> str:
    """``"Prix moyen annoncé en € courant"`` -> ``"prix_moyen_annonc_en_courant"``."""
    kept = _DROP.sub("", name)
    return _NON_ASCII.sub("", _SPACES.sub("_", kept.lower()))
