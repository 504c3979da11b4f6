"""Tokens, predicates and ids from label strings, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a class: what Python's ``str.isspace`` accepts.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
#: A run of letters, a run of digits, or one other sign; delimiters and white space only separate.
TOKEN = rf"([A-Za-z]+|\p{{Nd}}+|[^A-Za-z0-9 _./:\-{SPACE}])"
#: Inside a class: fixed values, what Python's ``str.isdigit`` accepts beside decimal digits.
OTHER_DIGITS = (
    "B2-B3 B9 1369-1371 19DA 2070 2074-2079 2080-2089 2460-2468 2474-247C 2488-2490 24EA 24F5-24FD 24FF 2776-277E 2780-2788 "
    "278A-2792 10A40-10A43 10E60-10E68 11052-1105A 1F100-1F10A"
)
DIGIT = r"\p{Nd}" + "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in OTHER_DIGITS.split())
UPPER_RATIO, MIN_LENGTH = 0.7, 3


def tokenize(label: Column) -> Column:
    """The label's tokens in order; null for null."""
    return F.regexp_extract_all(label, F.lit(TOKEN), F.lit(1))


def strip(text: Column) -> Column:
    visible = lambda c: c.between("!", "~")
    bare = visible(F.substring(text, 1, 1)) & visible(F.substring(text, -1, 1))
    return F.when(bare, text).otherwise(F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def is_digits(token: Column) -> Column:
    return token.rlike(f"^[{DIGIT}]+$")


def is_number_token(token: Column) -> Column:
    """``is_digits`` of a token of :func:`tokenize`: its first character tells, and ASCII ones by comparison alone."""
    return F.when(token < "0", False).when(token < ":", True).when(token < "\x80", False).otherwise(is_digits(token))


def is_upper(token: Column) -> Column:
    """Some letter is upper case, and none is lower or title case."""
    return token.rlike(r"\p{IsUppercase}") & ~token.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_point_like(text: Column) -> Column:
    """Mostly upper case, or a separator with a digit or capital, or a digit with a capital. Never null."""
    s = strip(text)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    capitals = F.regexp_count(s, F.lit(r"[\p{L}&&\p{IsUppercase}]"))
    mostly = F.coalesce(capitals / F.nullif(letters, F.lit(0)) >= UPPER_RATIO, F.lit(False))
    separator, digit, upper = s.contains("_") | s.contains(".") | s.contains("-"), s.rlike(f"[{DIGIT}]"), s.rlike(r"\p{IsUppercase}")
    like = (F.length(s) >= MIN_LENGTH) & (separator & (digit | upper) | digit & upper | mostly)  # letters are counted last
    return F.coalesce(like, F.lit(False))


def building_id(file_name: Column) -> Column:
    """The file's stem without leading digits and the ``_`` and ``-`` after them."""
    stem = F.regexp_replace(file_name, r"(?s)^(.+)\.[^.]+$", "$1")
    return F.regexp_replace(stem, r"^\p{Nd}+[_\-]*", "")
