"""Text transforms as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABC = "abcdefghijklmnopqrstuvwxyz"

# Letters and what they turn into at full strength.
LEET = ("aeiostAEIOST", "431057431057")
HOMOGLYPH = ("aceopxyACEOP", "асеорхуАСЕОР")


def upper(s: Column) -> Column:
    """Letter by letter: ß, whose capital is two letters, stays."""
    aside = "\ufdd0"
    return F.translate(F.upper(F.translate(s, "ß", aside)), aside, "ß")


def rot13(s: Column) -> Column:
    turn = _ABC[13:] + _ABC[:13]
    return F.translate(s, _ABC + _ABC.upper(), turn + turn.upper())


def spaced(s: Column) -> Column:
    """A space before every character but the first and spaces."""
    out = F.regexp_replace(s, r"([^ ])", " $1")
    return F.when(s.startswith(" ") | (s == ""), out).otherwise(F.substr(out, F.lit(2)))


def leet(s: Column) -> Column:
    return F.translate(s, *LEET)


def homoglyph(s: Column) -> Column:
    return F.translate(s, *HOMOGLYPH)


def clipped(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit(" […]"))).otherwise(s)


def byte_span(s: Column, start: Column, end: Column) -> Column:
    """The text of a span given in UTF-8 bytes."""
    return F.decode(F.substr(F.encode(s, "utf-8"), start + 1, end - start), "utf-8")


def family_pattern(glob: str) -> str:
    """A glob over family names as a regular expression; * and ? stay within one part of a path."""
    import re

    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "$"


#: Named transforms; callers may add their own.
TRANSFORMS = {"upper": upper, "lower": F.lower, "base64": lambda s: F.regexp_replace(F.base64(F.encode(s, "utf-8")), r"\r\n", ""), "hex": lambda s: F.lower(F.hex(F.encode(s, "utf-8"))), "rot13": rot13, "spaced": spaced, "leet": leet, "homoglyph": homoglyph}
