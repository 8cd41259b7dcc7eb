"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text.
WHITESPACE = (
    " \t\n\x0b\x0c\r"
    "\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same characters in patterns, where \s means the ASCII ones only.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_SPACE = "[^" + SPACE[1:]


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | (strip(text) == "")


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens: the default token function."""
    return F.regexp_count(_plain_spaces(text), F.lit(r"\S++")).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(_plain_spaces(text), F.lit(r"\S++"), F.lit(0))


def _plain_spaces(text: Column) -> Column:
    """Blanks for the white space that ``\\s`` leaves out: the classes of ASCII patterns are much faster to match."""
    odd = WHITESPACE[6:]
    return F.translate(text, odd, " " * len(odd))
