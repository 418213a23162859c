"""Missing-value rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens that count as missing (blank is handled separately).
MISSING_TOKENS = ("nan",)


# The characters that trimming removes on both ends (all Unicode white space).
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Text without white space at both ends (Spark's `trim` alone removes spaces only). Most texts have none there: only the
    others are trimmed against the whole list, which costs a microsecond or more."""
    s = col(c).cast("string")
    return F.when(_no_space(F.ascii(s)) & _no_space(F.ascii(F.substring(s, -1, 1))), s).otherwise(F.trim(s, F.lit(WHITE_SPACE)))


def _no_space(code: Column) -> Column:
    """A character number that is certainly no white space (no text: 0)."""
    return code.between(33, 126) | (code > 0x3000)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text or number -> double; unparsable -> null; NaN -> null."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def normalize_null(c) -> Column:
    """Blank, whitespace-only or `nan` text -> null, else the trimmed text."""
    t = strip(c)
    return F.when((t == "") | F.lower(t).isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(t)


def is_missing_value(c) -> Column:
    """Null, blank or `nan` text (as 0/1 boolean)."""
    t = strip(c)
    return col(c).isNull() | (t == "") | F.lower(t).isin(*MISSING_TOKENS)


def zero_if_null(c) -> Column:
    """Pandas `sum` of an all-missing group is 0."""
    return F.coalesce(col(c), F.lit(0))


def indicator(cond: Column) -> Column:
    """1.0 / 0.0 with a missing input counted as 0.0."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def safe_scale(sd, eps: float) -> Column:
    """A spread below eps (or null) divides by 1."""
    s = col(sd)
    return F.when(s.isNull() | (s < eps), F.lit(1.0)).otherwise(s)


def np_round(c, places: int = 4) -> Column:
    """Round like pandas / NumPy `round` (multiply, round half to even on the binary value, divide).
    Spark `round` rounds the decimal text half-up and differs on about 5 % of 4-place values."""
    p = float(10 ** places)
    return F.rint(col(c).cast("double") * p) / p


def mean_of_rounded(c, places: int = 4) -> Column:
    """Mean of values already rounded to `places`, rounded again to `places`, computed on the integer-scaled
    values so the sum is exact and the result does not depend on partitioning or summation order."""
    p = float(10 ** places)
    return F.rint(F.sum(F.rint(col(c).cast("double") * p)) / F.count(col(c))) / p


def canonical(c, places: int = 9) -> Column:
    """Value used for equality (distinct counts, rank ties): doubles rounded to 1e-9, so that sums computed in a
    different order (another partitioning, another engine) do not split a tie by one ulp."""
    return np_round(c, places)
