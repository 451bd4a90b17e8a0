"""Text Columns: trimming, normalising, tags and regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as re_parser
except ImportError:  # it is private; without it no pattern is told by its literal first
    re_parser = None

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that tag a text containing them.
KEYWORD_TAGS = ("pii", "sensitive", "private", "public", "internal")


def strip(text: Column) -> Column:
    """Remove outer white space of every kind (``trim`` alone removes only blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """The form of a text that decides whether two records are copies."""
    return F.lower(strip(text))


def keyword_tags(text: Column) -> Column:
    """Keywords occurring anywhere in the text, also inside longer words."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(word)), word) for word in KEYWORD_TAGS])
    )


def has_any_keyword(text: Column, words: Sequence[str]) -> Column:
    """True where the text contains one of the words; it is lower-cased once for all of them."""
    found = F.exists(
        F.array(F.lower(text)),
        lambda lowered: reduce(or_, [F.contains(lowered, F.lit(word)) for word in words]),
    )
    return F.coalesce(found, F.lit(False))


def required_literal(pattern: str) -> str:
    """The longest run of plain characters every match of the pattern contains, or ''."""
    if re_parser is None:
        return ""
    tree = re_parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs = [""]
    for kind, detail in tree:
        if kind is re_parser.LITERAL:
            runs[-1] += chr(detail)
        elif kind is not re_parser.AT:
            runs.append("")
    return max(runs, key=len)


# Groups and flags that Java's expressions lack or read otherwise.
PYTHON_ONLY = re.compile(r"\(\?(?:P|#|\(|[a-z]*[aLux])|\\[ZN]")
QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
CODE = re.compile(r"\\(?:U([0-9a-fA-F]{8})|(0[0-7]{0,2}|[0-3][0-7]{2}))")


def java_pattern(pattern: str) -> str:
    """A pattern of Python's ``re`` as Java reads it; refused where the two cannot agree.

    Inside a class Java nests on ``[`` and intersects on ``&&``; outside, it takes every brace for
    a quantifier and knows no ``{,n}``. Some escapes differ as well.
    """
    re.compile(pattern)
    if PYTHON_ONLY.search(re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"pattern uses syntax only Python's re knows: {pattern}")
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            number = None if pattern[at : at + 2] == "\\\\" else CODE.match(pattern, at)
            if number:
                code = int(number[1], 16) if number[1] else int(number[2], 8)
                out.append(f"\\x{{{code:x}}}")
                at = number.end()
                continue
            pair = pattern[at : at + 2]
            out.append({"\\v": "\\x0b", "\\b": "\\x08" if inside else "\\b"}.get(pair, pair))
            at += 2
            continue
        if inside:
            out.append(f"\\{c}" if c in "[&" else c)
            inside = c != "]"
        elif c == "[":
            inside = True
            start = re.compile(r"\[\^?\]?").match(pattern, at)[0]
            out.append(start.replace("]", "\\]"))
            at += len(start)
            continue
        elif c == "{":
            count = QUANTIFIER.match(pattern, at)
            if count and (count[1] or count[2]):
                out.append(f"{{{count[1] or 0}{count[2]}{count[3]}}}")
                at = count.end()
                continue
            out.append("\\{")
        else:
            out.append("\\}" if c == "}" else c)
        at += 1
    return "".join(out)


def _check_by_jvm(pattern: str) -> None:
    """Refuse at once what would fail the job later."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as error:
            raise ValueError(f"pattern cannot be carried over to Java: {pattern}") from error


def matches(text: Column, pattern: str) -> Column:
    """True where the regular expression is found anywhere in the text.

    Patterns are written for Python's ``re``. Plain words become a substring test; the rest
    run on the JVM with Python's reading of line ends and, where the pattern uses a character
    class, of Unicode classes. Texts lacking a character run the pattern needs are told by
    substring search alone, which is many times faster than the expression.
    """
    literal = required_literal(pattern)
    if is_plain(pattern):
        return F.contains(text, F.lit(literal))
    found = F.rlike(text, F.lit(java_expression(pattern)))
    return F.contains(text, F.lit(literal)) & found if literal else found


def is_plain(pattern: str) -> bool:
    """Whether a pattern is a text to be found as it stands."""
    literal = required_literal(pattern)
    return bool(literal) and literal == re.sub(r"\\([^\w\s])", r"\1", pattern)


def java_expression(pattern: str) -> str:
    """A pattern of Python's ``re`` for Java, with the flags it needs; refused if it cannot be carried over."""
    flags = "(?dU)" if re.search(r"\\[wWdDsSbB]|\(\?i", pattern) else "(?d)"
    carried = flags + java_pattern(pattern)
    _check_by_jvm(carried)
    return carried
