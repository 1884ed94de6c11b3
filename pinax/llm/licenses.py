"""License scans by template markup (operator 13).

A license is a template: mandatory wording with regions that may be left out or
replaced.  Templates are compiled into one automaton over words, which reads a
text once and reports a template wherever its mandatory wording stands exactly,
whatever the regions hold within their limits.  The automaton's sets of states
are built as texts need them and remembered, so a word costs one look-up, and
words from which no template can begin cost none.

Markup: ``<<optional>> ... <</optional>>`` may be missing (and may nest),
``<<var 1-12>>`` stands for any 1 to 12 words, ``<<one a b|c>>`` for one of the
wordings.  A template begins with a word.

Cases: a null or empty text has no words and no labels.  Repeated rows are
judged alike.  Matches may overlap, and never cross texts.  Input columns that
carry an output's name are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType

from .common import as_struct_type, blocks, per_row, range_hashes, runs, same_bytes, utf8, without


@dataclass(frozen=True)
class Template:
    """``label`` is given to texts with this wording, which also confirms the label ``of``."""

    label: str
    wording: str
    of: str | None = None


#: Phrases that are looked for as they stand.
PHRASES = [Template("mit", "mit license"), Template("apache", "apache license"),
           Template("gpl", "general public license")]

_AS_IS = ("<<optional>> this software is provided by <<var 1-12>> as is and any express or implied warranties "
          "including but not limited to the implied warranties of merchantability and fitness for a particular "
          "purpose are disclaimed <</optional>>")
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met <<optional>> 1 <</optional>> redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 "
        "<</optional>> redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution")
_UNDER = "<<optional>> the terms of <</optional>> the <<optional>> terms of the <</optional>>"
_GNU = "<<one licensed|released|distributed|available>> under " + _UNDER + " gnu <<one {}>> <<optional>> as published by " \
       "the free software foundation <</optional>> <<optional>> either <</optional>> <<one version {}|v{}>>"
_CC = "<<one licensed|released|available>> under <<optional>> a <</optional>> <<optional>> the <</optional>> " \
      "<<one cc|creative commons>> <<one {}>> 4 0"

#: Public license notices, as templates.
TEMPLATES = [
    Template("mit", "<<one released|licensed|distributed|available>> under " + _UNDER + " mit <<one license|licence>>",
             of="mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including "
             "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
             "of the software and to permit persons to whom the software is furnished to do so subject to the "
             "following conditions the above copyright notice and this permission notice <<optional>> including the "
             "next paragraph <</optional>> shall be included in all copies or substantial portions of the software",
             of="mit"),
    Template("apache-2.0", "<<one released|licensed|distributed|available>> under " + _UNDER + " apache "
             "<<one license|licence>> version 2 <<optional>> 0 <</optional>>", of="apache"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use "
             "<<one this file|this work|this software>> except in compliance with the license", of="apache"),
    *[Template(f"gpl-{v}.0", _GNU.format("general public <<one license|licence>>|gpl", v, v), of="gpl") for v in (2, 3)],
    *[Template(f"lgpl-{v}", _GNU.format("lesser general public license|lgpl", v.replace(".", " "), v.replace(".", " ")),
               of="gpl") for v in ("2.1", "3")],
    Template("agpl-3.0", _GNU.format("affero general public license|agpl", 3, 3), of="gpl"),
    Template("bsd-2-clause", _BSD + " " + _AS_IS),
    Template("bsd-3-clause", _BSD + " <<optional>> 3 <</optional>> neither the name of <<var 1-16>> nor the names of "
             "<<one its|their|the>> contributors may be used to endorse or promote products derived from this software "
             "without specific prior written permission " + _AS_IS),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted provided that the above copyright notice and this permission notice appear in all "
             "copies"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    *[Template(f"cc-{code.replace(' ', '-')}-4.0", _CC.format(f"{code}|{name}"))
      for code, name in (("by", "attribution"), ("by sa", "attribution sharealike"),
                         ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"),
                         ("by nc sa", "attribution noncommercial sharealike"),
                         ("by nc nd", "attribution noncommercial noderivatives"))],
    *[Template(label, f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}", of=of)
      for label, of in (("mit", "mit"), ("apache-2.0", "apache"), ("gpl-2.0", "gpl"), ("gpl-3.0", "gpl"),
                        ("bsd-2-clause", None), ("bsd-3-clause", None), ("isc", None), ("mpl-2.0", None))],
]

#: Sets of states that an automaton remembers before it starts anew.
MOST_SETS = 1 << 15
_TOKEN = re.compile(r"<</?optional>>|<<var (\d+)-(\d+)>>|<<one|<<|>>|\||[^\s<>|]+")


def parse(wording: str) -> list:
    """The template as a list of words, ``("optional", list)``, ``("var", low, high)`` and ``("one", lists)``."""
    tokens, at = list(_TOKEN.finditer(wording)), 0

    def sequence(stops: tuple[str, ...]) -> list:
        nonlocal at
        out: list = []
        while at < len(tokens) and tokens[at][0] not in stops:
            token, at = tokens[at], at + 1
            if token[0] == "<<optional>>":
                out.append(("optional", sequence(("<</optional>>",))))
                at += 1
            elif token[0] == "<<one":
                choices = [sequence(("|", ">>"))]
                while at < len(tokens) and tokens[at][0] == "|":
                    at += 1
                    choices.append(sequence(("|", ">>")))
                out.append(("one", choices))
                at += 1
            elif token[1]:
                out.append(("var", int(token[1]), int(token[2])))
            elif token[0].startswith("<") or token[0] in (">>", "|"):
                raise ValueError(f"{token[0]!r} has no place in a template: {wording}")
            else:
                out.append(token[0])
        if stops and at >= len(tokens):
            raise ValueError(f"a region is not closed: {wording}")
        return out

    return sequence(())


class Automaton:
    """Templates as states; each state has its words' next states, those of any word, and empty moves."""

    def __init__(self, templates: list[Template]):
        self.words: dict[str, int] = {}
        self.on: list[dict[int, list[int]]] = []
        self.any: list[list[int]] = []
        self.empty: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for no, template in enumerate(templates):
            start = self._state()
            self.accepts[self._sequence(parse(template.wording), start)] = no
            starts.append(start)
        self.start = self._closed(starts)
        if any(self.any[s] for s in self.start) or self.start & set(self.accepts):
            raise ValueError("a template must begin with a word")
        self.firsts = sorted({w for s in self.start for w in self.on[s]})
        self._forget()

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.empty.append([])
        return len(self.on) - 1

    def _sequence(self, items: list, at: int) -> int:
        for item in items:
            end = self._state()
            if isinstance(item, str):
                word = self.words.setdefault(item, len(self.words) + 1)
                self.on[at].setdefault(word, []).append(end)
            elif item[0] == "optional":
                self.empty[at].append(end)
                self.empty[self._sequence(item[1], at)].append(end)
            elif item[0] == "one":
                for choice in item[1]:
                    self.empty[self._sequence(choice, at)].append(end)
            else:
                for i in range(item[2]):
                    if i >= item[1]:
                        self.empty[at].append(end)
                    then = self._state()
                    self.any[at].append(then)
                    at = then
                self.empty[at].append(end)
            at = end
        return at

    def _closed(self, states: list[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _forget(self) -> None:
        """Sets of states by number; number 0 is the empty set, in which no template has begun."""
        self.sets: list[frozenset[int]] = [frozenset()]
        self.number = {frozenset(): 0}
        self.next: list[dict[int, int]] = [{}]
        self.found: list[list[int]] = [[]]

    def _step(self, number: int, word: int) -> int:
        to: list[int] = []
        for s in self.sets[number] | self.start:  # a template may begin at every word
            to += self.on[s].get(word, ())
            to += self.any[s]
        states = self._closed(to)
        if states not in self.number:
            if len(self.sets) >= MOST_SETS:
                self._forget()
                number = -1
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            self.found.append(sorted({self.accepts[s] for s in states if s in self.accepts}))
        if number >= 0:
            self.next[number][word] = self.number[states]
        return self.number[states]

    def read(self, tokens: list[int], begin: list[int], end: int) -> Iterator[tuple[int, int]]:
        """``(template, place of its last word)`` for each match; ``begin`` are the places of first words."""
        at = 0
        for first in begin:
            if first < at:
                continue
            at, state = first, 0
            while at < end:
                to = self.next[state].get(tokens[at])
                state = self._step(state, tokens[at]) if to is None else to
                if not state:
                    break
                for template in self.found[state]:
                    yield template, at
                at += 1


def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each byte, and which bytes words have."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return lower, inside


class _Tokens:
    """Numbers of a vocabulary's words in texts; 0 for all other words."""

    def __init__(self, vocabulary: dict[str, int]):
        words = [w.encode() for w in vocabulary]
        self.data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        hashes = range_hashes(self.data, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.starts, self.sizes = hashes[order], starts[order], (ends - starts)[order]
        self.numbers = np.array(list(vocabulary.values()), np.int64)[order]

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, sizes = range_hashes(data, starts, ends), ends - starts
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        maybe = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
        both = np.concatenate([data, self.data])
        same = maybe[same_bytes(both, starts[maybe], len(data) + self.starts[at[maybe]], sizes[maybe])]
        out = np.zeros(len(starts), np.int64)
        out[same] = self.numbers[at[same]]
        return out


OUTPUTS = [("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()),
           ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType())]


def scan(docs: DataFrame, phrases: list[Template] = PHRASES, templates: list[Template] = TEMPLATES,
         text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with the columns ``OUTPUTS``.

    ``n_base`` counts the places of ``phrases`` (plain words), ``first_word``
    and ``last_word`` are the smallest and largest of them; ``labels`` adds the
    labels of ``templates``.  A label that an accepted template carries or
    confirms counts 1, one of a phrase alone a half; ``score`` is their mean, 0
    without labels.
    """
    for p in phrases:
        if not all(isinstance(x, str) for x in parse(p.wording)):
            raise ValueError(f"a phrase has no markup: {p.wording}")
    docs = without(docs, [name for name, _ in OUTPUTS])
    shape = docs.drop(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton([*phrases, *templates]), [*phrases, *templates]
        sizes = [len(parse(p.wording)) for p in phrases]
        numbers = _Tokens(automaton.words)
        lower, inside = _word_bytes()
        for rb in blocks(batches, text_col):
            at = rb.schema.get_field_index(text_col)
            data, offs = utf8(rb.column(at))
            data = lower[data]
            starts, ends, row = runs(inside[data], offs)
            tokens = numbers.of(data, starts, ends)
            begin = np.flatnonzero(np.isin(tokens, automaton.firsts))
            upto = np.searchsorted(row, np.arange(rb.num_rows), side="right").tolist()
            from_ = [0, *upto[:-1]]
            token_list, rows_begun = tokens.tolist(), row[begin]
            cuts = np.searchsorted(rows_begun, np.arange(rb.num_rows + 1))
            begin = begin.tolist()
            columns: list[list] = [[] for _ in OUTPUTS[1:]]
            for i in range(rb.num_rows):
                places, base, labels, sure = [], set(), set(), set()
                for no, last in automaton.read(token_list, begin[cuts[i]:cuts[i + 1]], upto[i]):
                    labels.add(known[no].label)
                    if no < len(phrases):
                        base.add(known[no].label)
                        places.append(last - sizes[no] + 1 - from_[i])
                    else:
                        sure.add(known[no].label)
                        if known[no].of:
                            sure.add(known[no].of)
                score = (len(labels) + len(labels & sure)) / (2 * len(labels)) if labels else 0.0
                for column, value in zip(columns, (len(places), min(places, default=None), max(places, default=None),
                                                   ",".join(sorted(base)), ",".join(sorted(labels)), score)):
                    column.append(value)
            rb = rb.remove_column(at).append_column("n_words", pa.array(per_row(row, rb.num_rows)))
            for (name, kind), column in zip(OUTPUTS[1:], columns):
                arrow = pa.int64() if kind == LongType() else pa.string() if kind == StringType() else pa.float64()
                rb = rb.append_column(name, pa.array(column, arrow))
            yield rb

    return docs.mapInArrow(judge, as_struct_type(shape, *OUTPUTS))


def pattern(wording: str) -> str:
    """A regular expression for the template over words that are each followed by a blank."""

    def written(items: list) -> str:
        out = ""
        for item in items:
            if isinstance(item, str):
                out += re.escape(item) + " "
            elif item[0] == "optional":
                out += f"(?:{written(item[1])})?"
            elif item[0] == "one":
                out += "(?:" + "|".join(written(c) for c in item[1]) + ")"
            else:
                out += "(?:[^ ]+ ){%d,%d}" % item[1:]
        return out

    return " " + written(parse(wording))
