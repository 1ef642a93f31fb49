"""License scan: templates with optional and replaceable regions, compiled to word automata.

A template is text with markup: ``<<beginOptional>> words <<endOptional>>`` may be absent,
``<<var;max=6>>`` stands for up to six words of any kind, everything else is mandatory and
must match word for word.  Each template becomes a nondeterministic automaton over words;
its longest mandatory phrase is looked up first, so that texts without it cost one search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import as_bytes, rows

# Phrases of the base rule and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels and notice templates of widely used public licences.
TEMPLATES = [
    ("apache-2.0", "licensed under <<beginOptional>>the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3"),
    ("gpl-2.0", "gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 2"),
    ("lgpl", "gnu <<var;max=1>> general public license <<var;max=3>> lgpl"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> cc by nc 4 0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> cc by sa 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international <<beginOptional>>public<<endOptional>> license"),
    ("cc0-1.0", "cc0 1 0 <<beginOptional>>universal<<endOptional>> public domain dedication"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("copyright-notice", "copyright <<beginOptional>>c<<endOptional>> <<var;max=8>> all rights reserved"),
]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var(?:;max=(\d+))?)>>")


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(_FOLD).split()


def parse(template: str) -> list:
    """[word | ("opt", [...]) | ("var", most words)]."""
    stack, at = [[]], 0
    for m in _MARKUP.finditer(template):
        stack[-1] += words_of(template[at:m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            part = stack.pop()
            stack[-1].append(("opt", part))
        else:
            stack[-1].append(("var", int(m[2] or 10)))
    if len(stack) != 1:
        raise ValueError(f"unclosed optional region: {template}")
    return stack[0] + words_of(template[at:].encode())


class Automaton:
    """Word automaton of one template; state i has edges (word or None for any, next) and skips."""

    def __init__(self, label: str, template: str):
        self.label, self.edges, self.skips = label, [[]], [[]]
        parts = parse(template)
        if not any(isinstance(p, bytes) for p in parts):
            raise ValueError(f"a template needs mandatory words: {template}")
        self.end = self._build(parts, 0)
        run, best = [], []
        for p in [*parts, None]:
            run = [*run, p] if isinstance(p, bytes) else []
            best = max(best, run, key=lambda r: len(b" ".join(r)))
        self.anchor = b" " + b" ".join(best) + b" "
        self.first = self._closure({0})

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                after = self._state()
                self.edges[at].append((part, after))
            elif part[0] == "opt":
                after = self._build(part[1], at)
                self.skips[at].append(after)
            else:
                after, back = self._state(), at
                for _ in range(part[1]):
                    step = self._state()
                    self.edges[back].append((None, step))
                    self.skips[step].append(after)
                    back = step
                self.skips[at].append(after)
            at = after
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match_at(self, words: list[bytes], at: int) -> int | None:
        """Words of the longest match that starts at word ``at``."""
        states, longest, n = self.first, None, 0
        while states:
            if self.end in states:
                longest = n
            if at + n >= len(words):
                break
            word = words[at + n]
            states = self._closure({to for s in states for want, to in self.edges[s] if want is None or want == word})
            n += 1
        return longest or None

    def matches(self, words: list[bytes], norm: bytes) -> Iterator[tuple[str, int, int]]:
        if self.anchor not in norm:
            return
        starts = {w for s in self.first for w, _ in self.edges[s]}
        for at, word in enumerate(words):
            if word in starts or None in starts:
                n = self.match_at(words, at)
                if n:
                    yield self.label, at, n


def _phrase_starts(norm: bytes, phrase: bytes) -> list[int]:
    out, at = [], norm.find(phrase)
    while at >= 0:
        out.append(norm.count(b" ", 0, at))
        at = norm.find(phrase, at + 1)
    return out


_STRUCT = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_())]))


def _scan(batches, phrases, templates):
    automata = [Automaton(label, t) for label, t in templates]
    phrases = [(b" " + p.encode() + b" ", label, len(p.split())) for p, label in phrases.items()]
    for batch in batches:
        ids, counts, found = [], [], []
        for id_, data in rows(batch, "id", "data"):
            words = words_of(data)
            norm = b" " + b" ".join(words) + b" "
            own = [(label, at, n, True) for p, label, n in phrases if p in norm for at in _phrase_starts(norm, p)]
            own += [(*m, False) for a in automata for m in a.matches(words, norm)]
            ids.append(id_)
            counts.append(len(words))
            found.append([dict(zip(("label", "first_word", "n_words", "base"), x)) for x in sorted(own, key=lambda x: (x[1], x[0], x[2]))])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, _STRUCT)], names=["id", "n_words", "matches"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE_PHRASES,
                  templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, n_words, matches): one row per row, with every place of a phrase or template.

    A match has its label, first word (from 0), number of words and whether it is a phrase
    of the base rule.  Null and empty texts have no words and no matches; ids may be null or
    repeat; other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col).alias("data"))
    schema = "id long, n_words long, matches array<struct<label:string,first_word:long,n_words:long,base:boolean>>"
    return base.mapInArrow(lambda it: _scan(it, phrases, templates), schema).withColumnRenamed("id", id_col)


def as_regex(template: str) -> str:
    """The template as a pattern over words each followed by one space (for the SQL twin)."""
    def of(parts):
        out = ""
        for p in parts:
            if isinstance(p, bytes):
                out += re.escape(p.decode()) + " "
            elif p[0] == "opt":
                out += f"(?:{of(p[1])})?"
            else:
                out += f"(?:[^ ]+ ){{0,{p[1]}}}"
        return out
    return " " + of(parse(template))
