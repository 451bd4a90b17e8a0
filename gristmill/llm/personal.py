"""Personal data in plain and in disguise, with offsets into the source text.

Plain identifiers are matched as they stand. For disguised ones a text passes through transducers,
each of which rewrites some characters and keeps, for every character of its output, the stretch
of the source it came from: look-alike letters and digits, invisible characters, spelled digits,
"(at)" and "(dot)" in their spellings. The same detectors then read the normalised text, and what
they find is mapped back. Texts without any sign of a disguise skip the transducers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

# Possessive repeats and look-behinds keep long runs of one class linear; they exclude no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each @ back over the local part, at most to the end of the last match, and ahead."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + doubled) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterable[Span]]] = dict(
    zip(KINDS, (emails, addresses, cards, phones), strict=True)
)


class Tape:
    """A text, and for each of its characters the source stretch it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewritten(self, pattern: re.Pattern, replace: Callable[[re.Match], str]) -> Tape:
        """Put ``replace`` for each match; the characters written stand for all of the match."""
        texts, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new == m.group():
                continue
            i, j = m.span()
            texts += [self.text[done:i], new]
            starts += [self.start[done:i], np.full(len(new), self.start[i])]
            ends += [self.end[done:i], np.full(len(new), self.end[j - 1])]
            done = j
        if not done:
            return self
        texts.append(self.text[done:])
        starts.append(self.start[done:])
        ends.append(self.end[done:])
        return Tape("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.end[span[1] - 1])


# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip("авеікморстухѕјԁһαεικνορτυχ", "abeikmopctyxsjdhaeikvoptux", strict=True)
) | dict(zip("АВЕІКМНОРСТУХЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEIKMHOPCTYXSJABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = {"‐": "-", "‑": "-", "−": "-", "․": ".", " ": " ", " ": " "}


def plain_character(c: str) -> str:
    """What a character looks like: by the table, as a digit of any script, or as a wide form."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES or c in SIGNS:
        return LOOKALIKES.get(c) or SIGNS[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    wide = unicodedata.normalize("NFKC", c)
    # Compatibility forms of ASCII only; accents and powers stay.
    return wide if len(wide) == 1 and wide.isascii() and c not in "²³¹ªº" else c


FOREIGN = re.compile(r"[^\x00-\xa9\xae-ɏ]|[ ­]")

# Digits as English words.
SPELLED = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))
DIGIT = "|".join(SPELLED)
SPELLED_RUN = re.compile(rf"\b(?:{DIGIT})\b(?:[ ,-]{{1,3}}(?:{DIGIT})\b)+", re.I)
PLUS = re.compile(r"\bplus[ -]?(?=[0-9])", re.I)
# Blanks before a bracket are only read from their first one, which keeps long runs linear.
BEFORE, OPEN, CLOSE = r"(?:(?<![ \t])[ \t]++)?", r"[(\[{<][ \t]*", r"[ \t]*[)\]}>]"
BARE_AT, BARE_DOT = rf"{OPEN}(?:at|@){CLOSE}", rf"{OPEN}(?:dot|\.){CLOSE}"
AT = re.compile(rf"{BEFORE}{BARE_AT}[ \t]*", re.I)
DOT = re.compile(rf"{BEFORE}{BARE_DOT}[ \t]*", re.I)
WORDED_IP = re.compile(r"(?<=[0-9])[ \t]+dot[ \t]+(?=[0-9])", re.I)
WORDED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: at |@)[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+", re.I
)
# What makes any of the rewriting steps change a text first; ``unworded`` changes only what has " dot ".
DISGUISE = re.compile("|".join([SPELLED_RUN.pattern, PLUS.pattern, BARE_AT, BARE_DOT, WORDED_IP.pattern, " dot "]), re.I)
WORD_AT, WORD_DOT = re.compile(" at ", re.I), re.compile(" dot ", re.I)


def unworded(m: re.Match) -> str:
    text = m.group()
    return WORD_DOT.sub(".", WORD_AT.sub("@", text)) if " dot " in text.lower() else text


def normalised(text: str, gate: bool = True) -> Tape | None:
    """The text without its disguises; None where it has no sign of any, unless there is no gate."""
    foreign = not text.isascii() and FOREIGN.search(text)
    if gate and not foreign and not DISGUISE.search(text):
        return None
    tape = Tape(text)
    if foreign:
        tape = tape.rewritten(FOREIGN, lambda m: plain_character(m.group()))
    tape = tape.rewritten(
        SPELLED_RUN, lambda m: "".join(SPELLED[w.lower()] for w in re.findall(DIGIT, m.group(), re.I))
    )
    tape = tape.rewritten(PLUS, lambda m: "+")
    tape = tape.rewritten(AT, lambda m: "@").rewritten(DOT, lambda m: ".")
    return tape.rewritten(WORDED_IP, lambda m: ".").rewritten(WORDED, unworded)


def personal_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and those found only without disguise, by kind and start."""
    plain = [(kind, *span) for kind, find in DETECTORS.items() for span in find(text)]
    tape = normalised(text)
    if tape is None:
        return plain, []
    taken = sorted((i, j) for _, i, j in plain)
    added = []
    for kind, find in DETECTORS.items():
        for span in find(tape.text):
            i, j = tape.source(span)
            changed = text[i:j] != tape.text[span[0] : span[1]]
            if changed and not any(i < b and a < j for a, b in taken):
                added.append((kind, i, j))
    return plain, added


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the personal data in its whole text.

    ``plain`` are the leftmost non-overlapping matches of each kind as written, ``disguised`` those
    that only the normalised text shows and that touch no plain one. Offsets count code points, the
    end is exclusive. Null counts as empty; repeated rows and other columns make no difference; an
    empty table gives an empty result.
    """

    def work(rows):
        for doc, value in rows:
            plain, added = personal_spans(value or "")
            yield doc, *([dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in (plain, added))

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(slim, f"doc_id long, plain {SPANS}, disguised {SPANS}", work)


def listed(spans: str, order: tuple[str, ...]) -> F.Column:
    """Spans as kind:start:end, by kind as listed and start, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, order)), s["kind"])
    keyed = F.transform(
        spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op2_pii``; counts and digest are of plain spans, ``spans`` lists all."""
    found = find_personal(docs).withColumn("every", F.concat("plain", "disguised"))
    of = lambda kind: F.filter("plain", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed("plain", KINDS), 256).alias("base_sha256"),
        listed("every", KINDS).alias("spans"), F.size("disguised").cast("long").alias("n_disguised"),
    )


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Plain spans by the patterns as they are defined; for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out
