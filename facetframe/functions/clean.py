"""Cleaning rules for raw catalogue values, one Column expression per rule.

All rules follow the "falsy" convention of the source data: '' and 0 count as
missing wherever the original cleaning used Python's ``x or default``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetframe.functions.rounding import round_exact
from facetframe.functions.util import as_col, blank_to_null, or_else, strip_ws

# Accepted number text (Python ``float`` literal without nan/inf or
# digit separators) and the two recognised gender words.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MALE, FEMALE, UNKNOWN_GENDER = "Male", "Female", "Unknown"
UNKNOWN_RACE = "UNKNOWN"
UNDEFINED_RACE = "UNDEFINED"


def parse_number(c) -> Column:
    """Text -> double, null when the text is not a plain decimal number."""
    s = as_col(c).cast("string")
    return F.when(s.rlike(NUMBER_TEXT), F.trim(s).try_cast("double"))


def rating(c) -> Column:
    """Float rounded to one decimal; unparsable -> null."""
    return round_exact(parse_number(c), 1)


def digits_int(c) -> Column:
    """Keep only the digits and read them as an integer; nothing left -> 0."""
    d = F.regexp_replace(as_col(c).cast("string"), "[^0-9]", "")
    return F.coalesce(blank_to_null(d).try_cast("bigint"), F.lit(0).cast("bigint"))


def money_millions(c) -> Column:
    """C3: '$14,648,076' -> 14.65 (millions, 2 decimals); 'N/A', '', '$0' -> 0.0.

    Like the source rule it strips the decimal point too ('$1.50' reads 150).
    """
    return round_exact(digits_int(c).cast("double") / F.lit(1_000_000.0), 2)


def gender(c) -> Column:
    """C4: case-insensitive Male/Female, anything else Unknown."""
    u = F.upper(as_col(c))
    return (F.when(u == "MALE", F.lit(MALE))
             .when(u == "FEMALE", F.lit(FEMALE))
             .otherwise(F.lit(UNKNOWN_GENDER)))


def race(c) -> Column:
    """C5: '' / null / 'undefined' -> UNKNOWN, else upper case."""
    x = blank_to_null(c)
    u = F.upper(x)
    return F.when(x.isNull() | (u == UNDEFINED_RACE), F.lit(UNKNOWN_RACE)).otherwise(u)


def first_of_list(c, sep: str = ",") -> Column:
    """First element of a delimited text, whitespace-stripped; '' -> null."""
    s = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return blank_to_null(strip_ws(F.split(s, sep, 2).getItem(0)))


def truthy_number(c) -> Column:
    """Numeric value that is neither null nor 0 (NaN counts as present)."""
    x = as_col(c).cast("double")
    return x.isNotNull() & (x != F.lit(0.0))


def int_or_zero(c) -> Column:
    """``int(x or 0)``: null -> 0, truncation toward zero."""
    return F.coalesce(as_col(c).cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def other_awards(won, oscars_won, named, oscars_named, *others) -> Column:
    """C11: awards beyond the Oscars plus BAFTA and Emmy wins and nominations."""
    z = F.lit(0).cast("bigint")
    total = (F.greatest(z, int_or_zero(won) - int_or_zero(oscars_won))
             + F.greatest(z, int_or_zero(named) - int_or_zero(oscars_named)))
    for c in others:
        total = total + int_or_zero(c)
    return total


def year(c) -> Column:
    """Null / 0 / '' -> null, else the truncated integer year."""
    x = as_col(c).try_cast("double")      # text ('' -> null) and numbers alike
    return F.when(truthy_number(x), x.try_cast("int"))


def age(year_col, birth_col) -> Column:
    """Year - int(birth year), null when either is missing or 0."""
    y = as_col(year_col)
    b = as_col(birth_col).cast("double")
    return F.when(truthy_number(y) & truthy_number(b), y - b.try_cast("int"))


def spaced_list(raw_col) -> Column:
    """Raw comma list with ',' -> ', ' (an existing ', ' gets two spaces); null -> ''."""
    return F.replace(F.coalesce(as_col(raw_col), F.lit("")), F.lit(","), F.lit(", "))


def all_genres(list_col, spaced_raw_col, genre_col) -> Column:
    """List, else the spaced raw list (``spaced_list``), else genre; whitespace-stripped."""
    g = or_else(list_col, spaced_raw_col, genre_col)
    return F.when(blank_to_null(g).isNotNull(), strip_ws(g)).otherwise(as_col(genre_col))


# Title case: lower-case, then upper-case the first non-space character at the start
# of the text and after each whitespace, '-' or '/' that was not itself the character
# just upper-cased (a scan of ``(?:^|[\s\-/])(\S)`` consumes the separator).
_SEP = r"[\s\-/]"


def _cap_first(x) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def title_case(c) -> Column:
    """Title case with the separator rule above.

    Three exact paths: no separator at all -> upper-case the first character;
    no '-' or '/' directly after a separator (or at the start) -> upper-case the
    first character of every piece that follows a separator; otherwise a
    character scan that tracks whether the previous separator was consumed.
    """
    s = F.lower(as_col(c))
    chars = F.split(s, "")
    init = F.struct(F.lit("").alias("out"), F.lit(True).alias("pending"))

    def step(acc, ch):
        cap = acc["pending"] & ~ch.rlike(r"^\s$")
        out = F.concat(acc["out"], F.when(cap, F.upper(ch)).otherwise(ch))
        pending = F.when(cap, F.lit(False)).otherwise(ch.rlike("^" + _SEP + "$"))
        return F.struct(out.alias("out"), pending.alias("pending"))

    scan = F.aggregate(chars, init, step)["out"]
    pieces = F.array_join(F.transform(F.split(s, "(?<=" + _SEP + ")"), _cap_first), "")
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(s == "", F.lit(""))
             .when(~s.rlike(_SEP), _cap_first(s))
             .when(~s.rlike(r"^[\-/]|[\s\-/][\-/]"), pieces)
             .otherwise(scan))
