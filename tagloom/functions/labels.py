"""Category, BIO tags and structured view of token arrays, as built-in expressions without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.config import Vocabulary

#: ``[A-Z]`` without regard to case, as Python folds it.
_LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
# The patterns that give a token its category, tried in this order on the token as written.
PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("FLOOR", (r"[Ff][Ll]?\p{Nd}+", "[Ff][Ll][Oo][Oo][Rr]")),
    ("ZONE", (rf"[Rr][Mm]\p{{Nd}}+{_LETTER}?", rf"\p{{Nd}}{{3,4}}{_LETTER}?", rf"\p{{Nd}}{_LETTER}{{1,3}}\p{{Nd}}{{1,3}}")),
    ("EQUIP_ID", (r"\p{Nd}+", r"[A-Z]?\p{Nd}{2,3}[A-Z]?")),
    ("BLDG", (r"[Bb][Ll][Dd][Gg]\p{Nd}+",)),
)
#: Tokens without a digit are MISC but for the word, so most meet one pattern only.
_ANY = r"(?d)\p{Nd}|^[Ff][Ll][Oo][Oo][Rr]$"
FIRST = {"bldg": "BLDG", "floor": "FLOOR", "equip": "EQUIP", "equip_id": "EQUIP_ID"}
LAST = {"subcomp": "SUBCOMP", "point_func": "POINT_FUNC", "io_type": "IO_TYPE", "vendor": "VENDOR_TAG"}
FIELDS = ("bldg", "floor", "zone", "equip", "equip_id", "subcomp", "point_func", "io_type", "vendor")


def by_pattern(token: Column) -> Column:
    """The category of the first pattern that fits. What no pattern starts with is MISC, and what starts with a digit fits few of them."""
    fits = {category: token.rlike("(?d)^(?:" + "|".join(patterns) + ")$") for category, patterns in PATTERNS}
    number = F.when(fits["ZONE"], "ZONE").when(fits["EQUIP_ID"], "EQUIP_ID").otherwise("MISC")
    out = F.when(token < "0", "MISC").when(token < ":", number).when(~token.rlike(_ANY), "MISC")
    for category, _ in PATTERNS:
        out = out.when(fits[category], category)
    return out.otherwise("MISC")


def label_token(token: Column, vocabulary: Vocabulary, upper: Column | None = None) -> Column:
    """The first category whose terms hold the upper-cased token, else the first whose pattern fits, else MISC."""
    upper, out = F.upper(token) if upper is None else upper, None
    for category, terms in vocabulary.in_lookup_order():
        if terms:
            hit = upper.isin(*sorted(terms))
            out = F.when(hit, category) if out is None else out.when(hit, category)
    return by_pattern(token) if out is None else out.otherwise(by_pattern(token))


def label_tokens(tokens: Column, vocabulary: Vocabulary) -> Column:
    both = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.upper(t).alias("u")))
    return F.transform(both, lambda x: label_token(x["t"], vocabulary, x["u"]))


def bio_tags(categories: Column) -> Column:
    """``B-`` where a category starts, ``I-`` where it goes on, ``O`` for MISC and null."""

    def tag(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(categories, i - 1))
        outside = c.isNull() | (c == "MISC")
        return F.when(outside, "O").when(c.eqNullSafe(before), F.concat(F.lit("I-"), c)).otherwise(F.concat(F.lit("B-"), c))

    return F.transform(categories, tag)


def structured(tokens: Column, categories: Column) -> Column:
    """One token for each field: the first, or the last, of its category; all zone tokens, joined by blanks.

    Arrays of unequal length are read as far as the shorter goes.
    """
    n = F.least(F.array_size(tokens), F.array_size(categories))
    known = F.when(F.array_size(tokens) == F.array_size(categories), categories).otherwise(F.slice(categories, 1, n))
    back = F.reverse(known)

    def last(category: str) -> Column:
        place = F.array_position(back, category)
        return F.when(place > 0, F.get(tokens, n - place.cast("int")))

    zone = F.filter(tokens, lambda _, i: F.get(known, i) == "ZONE")
    values = {"zone": F.when(F.array_contains(known, "ZONE"), F.array_join(zone, " "))}
    values |= {name: F.get(tokens, F.array_position(known, category).cast("int") - 1) for name, category in FIRST.items()}
    values |= {name: last(category) for name, category in LAST.items()}
    return F.struct(*(values[name].alias(name) for name in FIELDS))
