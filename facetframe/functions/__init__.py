"""Column-level rules (rounding, cleaning, title case); all built-in expressions."""

from facetframe.functions import clean, rounding  # noqa: F401
from facetframe.functions.rounding import round_exact, round_half_up, to_fixed  # noqa: F401
