"""Small Column helpers shared by the rule modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the characters Python's ``str.strip()`` removes.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """'' -> null; the "falsy string" rule (Python ``x or default``)."""
    x = as_col(c)
    return F.when(x == F.lit(""), F.lit(None)).otherwise(x)


def or_else(*cols) -> Column:
    """Python ``a or b or c`` for strings: the first value that is neither null nor '',
    else the last value as it is (so ``x or ''`` yields '')."""
    *head, last = cols
    return F.coalesce(*[blank_to_null(c) for c in head], as_col(last))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing white space, Unicode's included."""
    return F.regexp_replace(as_col(c), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def nulls_last_key(*cols) -> list[Column]:
    """Ascending sort key with nulls last, usable inside ``F.struct`` for min_by."""
    key: list[Column] = []
    for c in cols:
        x = as_col(c)
        key.append(x.isNull())
        key.append(x)
    return key
