"""Licences in texts, by sentence rules.

A text is cut into sentences, which run over single line ends up to a mark or a blank line. A
sentence that mentions licensing at all is normalised line by line, which also takes comment
prefixes away, and known licence sentences are looked for from each of its lines to the end of the
same or a later line; that gives them identifiers. The identifiers, in the order of the text, are
then matched with ordered rules: full licence texts before notices, notices before bare mentions.
A rule's sentences may be parted by a few others; each sentence serves one match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_rows

# A sentence ends before a line without words, or at a mark with white space or nothing behind it.
SENTENCE = re.compile(
    r"(?=\S)(?:[^\n.!?;]++|[.!?;](?!\s|\Z)|\n(?![^\w\n+]*+(?:\n|\Z)))*+[.!?;]?"
)
MENTIONS = re.compile(
    r"licen[cs]|copyright|\brights\W+reserved|permission|warrant|redistribut|spdx|public\W+domain|\bcc\W+by|merchantab",
    re.I,
)
NOT_WORD = re.compile(r"[^\w.+]+|\.(?!\d)")
WORD_PREFIX = re.compile(r"\s*(?:dnl|rem)\s", re.I)  # comment prefixes that are words

# Known sentences in normalised form (lower case, words parted by one blank, British
# spelling of the noun folded), with the identifier each stands for.
_VIA = r"(?:this (?:work|file|software|project|code|program|document|text|article|page)s? (?:is |are )?)?"
_BY = r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-2.0-notice", _VIA + _BY + r"apache license (?:version )?2(?:\.0)?(?: the license)?"),
    ("apache-comply", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at.*"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("mit-notice", _VIA + _BY + r"mit license"),
    ("mit-title", r"(?:the )?mit license(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-keep", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"the software is provided as is without warranty of any kind.*"),
    ("no-liability", r"in no event shall the (?:authors|copyright holders?).*be liable.*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd-source", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-name", r"(?:3 )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd-notice", _VIA + _BY + r"(?:(?:new|modified|simplified|[23] clause) )?bsd (?:(?:[23]) clause )?license"),
    ("gpl-2.0-notice", _VIA + _BY + r"gnu general public license (?:version |v)?2(?:\.0)?"),
    ("gpl-3.0-notice", _VIA + _BY + r"gnu general public license (?:version |v)?3(?:\.0)?"),
    ("lgpl-2.1-notice", _VIA + _BY + r"gnu lesser general public license (?:version |v)?2\.1"),
    ("lgpl-3.0-notice", _VIA + _BY + r"gnu lesser general public license (?:version |v)?3(?:\.0)?"),
    ("agpl-3.0-notice", _VIA + _BY + r"gnu affero general public license (?:version |v)?3(?:\.0)?"),
    ("gpl-free-2", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license.* either version 2 of the license.*"),
    ("gpl-free-3", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license.* either version 3 of the license.*"),
    ("gpl-free", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("gpl-version-2", r"either version 2 of the license.*"),
    ("gpl-version-3", r"either version 3 of the license.*"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful.*"),
    ("gpl-copy", r"you should have received a copy of the gnu general public license.*"),
    ("mpl-2.0-notice", r"this source code form is subject to the terms of the mozilla public license v 2\.0|" + _VIA + _BY + r"mozilla public license (?:version |v )?2\.0"),
    ("cc0-notice", _VIA + _BY + r"(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?"),
    ("unlicense-free", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:this work is |released |dedicated )*(?:in|into|to) the public domain"),
    ("all-rights-reserved", r"all rights reserved"),
    ("all-rights-reserved", r"copyright.* all rights reserved"),
)
# Sentences whose licence is a part of them: (identifier, pattern, how the licence is named).
NAMED: tuple[tuple[str, str, str], ...] = (
    ("cc-notice", _VIA + r"(?:" + _BY + r")?(?:a )?(?:cc|creative commons) (by(?: nc)?(?: sa| nd)?) ([1-4]\.0)(?: international)?(?: license)?", "CC-{0}-{1}"),
    ("spdx", r"spdx license identifier ([a-z0-9.+ ]+)", "{0}"),
)

# Rules in order; (licence, identifiers in their order). The first that fits counts.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2.0-notice", "apache-comply", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-comply")),
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("GPL-3.0-or-later", ("gpl-free-3",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-version-2")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version-3")),
    ("ISC", ("isc-grant", "as-is")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("BSD", ("bsd-notice",)),
    ("GPL-2.0", ("gpl-2.0-notice",)),
    ("GPL-3.0", ("gpl-3.0-notice",)),
    ("LGPL-2.1", ("lgpl-2.1-notice",)),
    ("LGPL-3.0", ("lgpl-3.0-notice",)),
    ("AGPL-3.0", ("agpl-3.0-notice",)),
    ("GPL", ("gpl-free",)),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense-free",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("all-rights-reserved",)),
)
GAP = 3  # sentences between two of a rule's, at most

BLANK = re.compile(r" (?![^\[]*\])")  # not inside a character class


def wrapped(pattern: str, end: str = "") -> re.Pattern:
    """A known sentence's pattern with a line end wherever it has a blank."""
    return re.compile(BLANK.sub(r"[ \\n]", pattern) + end)


LINE_END = r"(?=\n|\Z)"


@dataclass(frozen=True)
class Known:
    """A known sentence: its beginning, what has to follow anywhere behind, and whether it then goes on."""

    name: str
    head: re.Pattern
    tail: re.Pattern | None
    goes_on: bool
    form: str | None = None

    @classmethod
    def of(cls, name: str, pattern: str, form: str | None = None) -> Known:
        goes_on = pattern.endswith(".*")
        head, _, tail = pattern.removesuffix(".*").partition(".*")
        end = "" if goes_on else LINE_END
        return cls(name, wrapped(head, "" if tail else end), wrapped(tail, end) if tail else None, goes_on, form)

    def identifier(self, m: re.Match) -> str:
        """Sentences that name a licence carry it behind a colon."""
        if not self.form:
            return self.name
        return f"{self.name}:{self.form.format(*('-'.join(g.upper().split()) for g in m.groups()))}"


KNOWN = tuple(Known.of(*sentence) for sentence in (*SENTENCES, *NAMED))
KNOWN_WHOLE = tuple(k for k in KNOWN if not k.tail)
KNOWN_PARTED = tuple(k for k in KNOWN if k.tail)
FIRST_OF = {name: [r for r in RULES if r[1][0] == name] for name, _ in SENTENCES}

Sentence = tuple[int, int, int, str]  # number, start, end, identifier


def normal(line: str) -> str:
    words = NOT_WORD.sub(" ", WORD_PREFIX.sub(" ", line.lower(), count=1)).split()
    return " ".join("license" if w == "licence" else "licensed" if w == "licenced" else w for w in words)


def known_parts(sentence: str) -> list[tuple[int, int, str]]:
    """The known sentences in one, each from the beginning of a line to the end of one: (start, end, identifier).

    A sentence without a full stop may be several lines that stand for themselves, so no known
    sentence runs on over a line with which another begins.
    """
    lines, at = [], 0  # normalised, start, end
    for line in sentence.split("\n"):
        if words := normal(line):
            lines.append((words, at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
        at += len(line) + 1
    text = "\n".join(line[0] for line in lines)
    starts = list(accumulate((len(line[0]) + 1 for line in lines[:-1]), initial=0))
    hits: list[tuple[int, Known, str] | None] = []  # per line, where the known sentence's own words end
    for start in starts:
        found = ((k, m) for k in KNOWN_WHOLE if (m := k.head.match(text, start)))
        hit = next(found, None)
        hits.append(hit and (hit[1].end(), hit[0], hit[0].identifier(hit[1])))
    following = [len(starts)] * len(starts)  # the next line with which a known sentence begins
    for i in reversed(range(len(starts) - 1)):
        following[i] = i + 1 if hits[i + 1] else following[i + 1]
    tails: dict[re.Pattern, re.Match | None] = {}
    for i, start in enumerate(starts):
        for k in KNOWN_PARTED:
            if not (m := k.head.match(text, start)):
                continue
            # Lines come in order, so a tail found ahead of an earlier line still is the next one.
            last = tails.get(k.tail, m)
            if last and (last is m or last.start() < m.end()):
                last = tails[k.tail] = k.tail.search(text, m.end())
            if last and bisect_right(starts, last.end() - 1) - 1 < following[i]:
                hits[i] = last.end(), k, k.name
                break
    begins = [i for i, hit in enumerate(hits) if hit]
    parts, i = [], 0
    for place, begin in enumerate(begins):
        if begin < i:
            continue
        end, k, name = hits[begin]
        last = bisect_right(starts, end - 1) - 1
        if k.goes_on:
            later = bisect_right(begins, last, lo=place)
            last = (begins[later] if later < len(begins) else len(starts)) - 1
        parts.append((lines[begin][1], lines[last][2], name))
        i = last + 1
    return parts


def recognised(text: str) -> tuple[int, list[Sentence]]:
    """How many sentences there are, and those that are known."""
    if not MENTIONS.search(text):
        return sum(1 for _ in SENTENCE.finditer(text)), []
    n, found = 0, []
    for m in SENTENCE.finditer(text):
        parts = known_parts(m.group()) if MENTIONS.search(m.group()) else []
        at = 0
        for start, end, name in parts:
            n += bool(NOT_WORD.sub("", m.group()[at:start]))  # what stands before counts as one
            found.append((n, m.start() + start, m.start() + end, name))
            n, at = n + 1, end
        n += not parts or bool(NOT_WORD.sub("", m.group()[at:]))
    return n, found


def fits(rule: tuple[str, ...], found: list[Sentence], at: int) -> bool:
    part = found[at : at + len(rule)]
    return [s[3] for s in part] == list(rule) and all(
        b[0] - a[0] <= GAP + 1 for a, b in zip(part, part[1:], strict=False)
    )


def matches(found: list[Sentence]) -> Iterator[tuple[str, int, int]]:
    """(licence, start, end) from left to right, by the first rule that fits at each sentence."""
    at = 0
    while at < len(found):
        _, start, end, name = found[at]
        if ":" in name:
            yield name.split(":", 1)[1], start, end
            at += 1
            continue
        rule = next((r for r in FIRST_OF[name] if fits(r[1], found, at)), None)
        if rule:
            yield rule[0], start, found[at + len(rule[1]) - 1][2]
        at += len(rule[1]) if rule else 1


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the licences its whole text states, with code point spans.

    Null and empty texts have no sentences. Repeated rows are judged alike, other columns ignored;
    an empty table gives an empty result. Returns ``doc_id``, ``n_sentences``, ``n_known`` (known
    licence sentences) and ``licenses`` (license, start, end).
    """

    def work(rows: list) -> Iterable[tuple]:
        for doc, value in rows:
            n, found = recognised(value or "")
            spans = [{"license": name, "start": i, "end": j} for name, i, j in matches(found)]
            yield doc, n, len(found), spans

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_sentences long, n_known long, licenses array<struct<license:string,start:int,end:int>>"
    return map_rows(slim, schema, work)


def license_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op10_license_scan``."""
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"]))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["license"])))
    return scan_licenses(docs).select(
        "doc_id", "n_sentences", "n_known", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"),
    )
