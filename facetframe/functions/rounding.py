"""The three rounding rules used by the catalogue (all JVM-side expressions).

* ``round_exact``   - round the exact binary value, ties to even (Python's ``round``).
* ``round_half_up`` - ``floor(x * 10^n + 0.5) / 10^n`` (JavaScript ``Math.round`` scaled).
* ``to_fixed``      - text rounding of the exact binary value with ties away from
                      zero (JavaScript ``Number.prototype.toFixed``), returned as double.

``F.round`` rounds the decimal *text* of a double half-up and ``F.bround`` rounds it
half-even; neither looks at the exact binary value, so both differ from Python on
values such as 1.25 vs 1.15. ``format_number`` with a pattern goes through
``java.text.DecimalFormat``, which rounds the exact binary value half-even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetframe.functions.util import as_col


def _pattern(n: int) -> str:
    return "0" if n <= 0 else "0." + "0" * n


def round_exact(c, n: int = 1) -> Column:
    """Python ``round(x, n)`` on doubles: exact binary value, ties to even."""
    x = as_col(c).cast("double")
    # null stays null and NaN stays NaN, as with Python's round; the input is
    # referenced once so the generated code stays small.
    return F.call_function("format_number", x, F.lit(_pattern(n))).try_cast("double")


def round_half_up(c, n: int = 1) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` computed in double precision."""
    x = as_col(c).cast("double")
    s = float(10 ** n)
    return F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s)


def to_fixed(c, n: int = 1) -> Column:
    """Numeric value of ``x.toFixed(n)``: nearest n-decimal value, exact ties away from zero.

    An exact tie at n decimals needs a dyadic value, so it can only occur when
    ``|x| * 2^(n+1)`` is an integer; that product is exact in binary. Every
    other value has a unique nearest neighbour, which ``round_exact`` returns.
    """
    x = as_col(c).cast("double")
    ax = F.abs(x)
    p2 = float(2 ** (n + 1))
    s = float(10 ** n)
    tie_case = (ax * F.lit(p2)) == F.floor(ax * F.lit(p2))
    half_up = F.signum(x) * F.floor(ax * F.lit(s) + F.lit(0.5)) / F.lit(s)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
            .when(tie_case, half_up) \
            .otherwise(round_exact(x, n))
