"""Licence wording by templates with markup, matched by token automata.

A template is a licence's wording with two kinds of regions: `<<optional>> ... <<end>>` may be left out, and
`<<any N>>` stands for up to N words of any kind (names, dates, numbers). All other wording is mandatory and must stand
word for word. A template is compiled into an automaton over words: a bit for each word of the wording, one step for
each word of the text, and jumps over regions that may be left out. A text is read once; an automaton starts where its
first words stand and stops when no state is left, so its work is bounded by the template and not by the text.

Upper and lower case of A to Z are alike, and words are runs of letters, digits and signs beyond ASCII. Null or empty
text has no words and no match. Rows that repeat, share a doc_id or have none are judged each on its own; an empty
table gives no rows; other columns are not read, whatever their names. A very long text is read by its own task as one
list of words. Matches may overlap (a phrase inside a licence counts as well), and are ordered by start, then end,
then label.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices

#: How much a match says: a bare name, a notice that the licence applies, the licence's own grant.
WEIGHT = {"base": 0.5, "notice": 0.75, "grant": 1.0}

# Names of licences as the contract lists them.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

# Public licence wording (label, kind, template). Every template begins with mandatory wording.
TEMPLATES = (
    ("mit", "notice", "released under <<optional>>the<<end>> <<optional>>terms of the<<end>> MIT License"),
    ("mit", "notice", "licensed under <<optional>>the<<end>> <<optional>>terms of the<<end>> MIT License"),
    ("mit", "notice", "distributed under <<optional>>the<<end>> <<optional>>terms of the<<end>> MIT License"),
    ("mit", "grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included
        in all copies or substantial portions of the Software"""),
    ("apache-2.0", "notice", "licensed under the Apache License <<optional>>Version<<end>> 2.0"),
    ("apache-2.0", "grant", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any 4>> except in compliance with the License.
        You may obtain a copy of the License at <<any 12>> Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""),
    ("gpl-3.0", "notice", "licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-2.0", "notice", "licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2"),
    ("gpl-3.0-or-later", "grant", """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation <<optional>>either<<end>> version 3 of the License, or (at your option) any later version"""),
    ("gpl-2.0-or-later", "grant", """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation <<optional>>either<<end>> version 2 of the License, or (at your option) any later version"""),
    ("cc-by-4.0", "notice", "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY 4.0"),
    ("cc-by-nc-4.0", "notice", "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "notice", "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-SA 4.0"),
    ("cc-by-4.0", "notice", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "grant", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-3-clause", "grant", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<any 1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<any 1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. <<any 1>> Neither the name of <<any 12>> nor the names of <<any 3>> contributors may be
        used to endorse or promote products derived from this software without specific prior written permission"""),
    ("bsd-2-clause", "grant", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<any 1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<any 1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS\""""),
)

_MARK = re.compile(r"<<(optional|end|any (\d+))>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def parse(template: str) -> list[tuple[str, str | int, list]]:
    """("word", w, []), ("any", most, []) and ("optional", 0, parts) in order."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(template), None]:
        stack[-1] += [("word", w, []) for w in words_of(template[at : m.start() if m else len(template)])]
        if m is None:
            break
        at = m.end()
        if m[1] == "optional":
            stack.append([])
        elif m[1] == "end":
            if len(stack) == 1:
                raise ValueError("a region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(("optional", 0, inner))
        else:
            stack[-1].append(("any", int(m[2]), []))
    if len(stack) > 1:
        raise ValueError("a region does not end")
    if not stack[0] or stack[0][0][0] != "word" or stack[0][-1][0] == "any":
        raise ValueError("a template begins and ends with wording")
    return stack[0]


class Automaton:
    """A template's states are the places between its words; state i waits for word i. A set of states is the bits of
    one number, so a step is a shift under the mask of places that the word fits."""

    def __init__(self, label: str, kind: str, template: str):
        self.label, self.kind = label, kind
        parts = parse(template)
        self.first = parts[0][1]
        places: list[str | None] = []  # a word, or None for any word
        self.jumps: list[tuple[int, int]] = []  # from a place to one behind a region that may be left out
        self._lay(parts, places)
        self.goal = 1 << len(places)
        self.fits: dict[str, int] = {}
        self.any = sum(1 << i for i, w in enumerate(places) if w is None)
        for i, w in enumerate(places):
            if w is not None:
                self.fits[w] = self.fits.get(w, self.any) | 1 << i
        self.jumps.sort()

    def _lay(self, parts, places) -> None:
        for kind, value, inner in parts:
            if kind == "word":
                places.append(value)
            elif kind == "any":
                at = len(places)
                places.extend([None] * value)
                self.jumps += [(at + i, at + value) for i in range(value)]
            else:
                at = len(places)
                self._lay(inner, places)
                self.jumps.append((at, len(places)))

    def _closed(self, states: int) -> int:
        for here, there in self.jumps:
            if states >> here & 1:
                states |= 1 << there
        return states

    def longest(self, words: list[str], start: int) -> int | None:
        """Where the longest match that starts here ends (exclusive), if there is one."""
        states, end = 1, None
        for at in range(start, len(words)):
            states = self._closed((states & self.fits.get(words[at], self.any)) << 1)
            if not states:
                break
            if states & self.goal:
                end = at + 1
        return end


@lru_cache(maxsize=8)
def compiled(templates: tuple) -> dict[str, list[Automaton]]:
    """Automata by their first word; the contract's names are templates without regions."""
    out: dict[str, list[Automaton]] = {}
    for label, kind, template in (*((label, "base", phrase) for label, phrase in BASE), *templates):
        made = Automaton(label, kind, template)
        out.setdefault(made.first, []).append(made)
    return out


def matches(words: list[str], automata: dict[str, list[Automaton]]) -> list[tuple[int, int, str, str]]:
    """(start, end, label, kind) of the longest match of each template at each place."""
    if automata.keys().isdisjoint(words):
        return []
    out = []
    for at, word in enumerate(words):
        for a in automata.get(word, ()):
            end = a.longest(words, at)
            if end is not None:
                out.append((at, end, a.label, a.kind))
    return sorted(set(out))


#: Bytes outside words become blanks, A to Z become small.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string())])


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, matches: array of start, end (words from 0, end exclusive), label, kind."""

    def run(batches):
        automata = {first.encode(): own for first, own in compiled(templates).items()}
        firsts = automata.keys()
        for batch in slices(batches, 500):
            counts, found = [], []
            for text in byte_texts(batch.column(1)):
                words = (text or b"").translate(_TABLE).split()
                counts.append(len(words))
                own = [] if firsts.isdisjoint(words) else matches([w.decode("utf-8", "replace") for w in words], compiled(templates))
                found.append([dict(zip(("start", "end", "label", "kind"), m)) for m in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(MATCH))], ["doc_id", "n_words", "matches"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_words long, matches array<struct<start: bigint, end: bigint, label: string, kind: string>>")


def labelled(found: DataFrame) -> DataFrame:
    """The contract's columns from scan(). score: how much the strongest match says (WEIGHT), 0 without one."""
    base = F.filter("matches", lambda m: m["kind"] == "base")
    starts = F.transform(base, lambda m: m["start"])
    names = lambda own: F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda m: m["label"]))), ",")
    weigh = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHT.items() for x in kv)), m["kind"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", weigh)), F.lit(0.0)).alias("score"),
    )


def _pattern(parts: list) -> str:
    """A template as a regular expression over words that each end in a blank."""
    return "".join(f"{value} " if kind == "word" else f"(?:[^ ]+ ){{0,{value}}}" if kind == "any" else f"(?:{_pattern(inner)})?" for kind, value, inner in parts)


def oracle(templates: tuple = TEMPLATES) -> str:
    """The same in SQL: each template as a regular expression over the text's words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = ", ".join(f"('{label}', {words_of(phrase)!r})" for label, phrase in BASE)
    rest = ", ".join(f"('{label}', {WEIGHT[kind]}, ' {_pattern(parse(t))}')" for label, kind, t in templates)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b(label, phrase) AS (VALUES {base}),
     t(label, weight, pattern) AS (VALUES {rest}),
     p AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, b WHERE list_has_any(w, phrase[1:1])),
     g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
     m AS (SELECT doc_id, label, weight FROM d, t WHERE regexp_matches(' ' || array_to_string(w, ' ') || ' ', pattern) UNION ALL SELECT doc_id, label, {WEIGHT["base"]} FROM p),
     a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)
"""
