"""Period keys and id normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.nulls import col, normalize_null, strip, to_number

# Pattern of a Chinese term label such as `2020-2021学年第2学期` (spaces tolerated),
# and of a time-of-day text `H:MM:SS`.
TERM_TEXT_PATTERN = r"(\d{4})\s*-\s*(\d{4}).*?第\s*([12])\s*学期"
TIME_ONLY_PATTERN = r"^\s*\d{1,2}:\d{2}:\d{2}\s*$"
# Id prefix and minimum length of "looks like a student id".
ID_PREFIX = "pj"
ID_MIN_LEN = 6


def _key(y: Column, half: Column) -> Column:
    return F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"), F.lit("-"), half.cast("string"))


def term_from_code(c) -> Column:
    """Grade-table term code kept as is after trimming; blank / `nan` -> null."""
    return normalize_null(c)


def term_from_text(c) -> Column:
    """`2020-2021学年第2学期` -> `2020-2021-2`; no match -> null."""
    s = normalize_null(c)
    # one regex pass: the leftmost match is rewritten to SENTINEL + key; no match leaves the text unchanged
    r = F.regexp_replace(s, r"(?s)^.*?" + TERM_TEXT_PATTERN + r".*$", "\u0001$1-$2-$3")
    return F.when(r.startswith("\u0001") & (r != s), r.substr(F.lit(2), F.length(r)))


def _year_int(c) -> Column:
    return to_number(c).try_cast("int")


def term_from_year(c) -> Column:
    """Year (text like `2020.0` allowed) -> `y-(y+1)-2`."""
    y = _year_int(c)
    return _key(y, F.lit(2))


def term_from_year_month(y, m) -> Column:
    """Month >= 8 -> first half of the year label, else second."""
    yy = _year_int(y)
    mm = to_number(m)
    return F.when(yy.isNotNull() & mm.isNotNull(), _key(yy, F.when(mm >= 8, F.lit(1)).otherwise(F.lit(2))))


def term_from_date(c) -> Column:
    """P5: timestamp or date text -> term key, calendar-year convention (Q1); bad date -> null."""
    c = col(c)
    d = F.try_to_timestamp(c.cast("string"))
    return F.when(d.isNotNull(), _key(F.year(d), F.when(F.month(d) >= 8, F.lit(1)).otherwise(F.lit(2))))


def term_from_ts(c) -> Column:
    """P5 for a typed timestamp column (no text round-trip)."""
    c = col(c)
    return _key(F.year(c), F.when(F.month(c) >= 8, F.lit(1)).otherwise(F.lit(2)))


def time_to_seconds(c) -> Column:
    parts = F.split(F.trim(col(c)), ":")
    return (parts.getItem(0).try_cast("double") * 3600 + parts.getItem(1).try_cast("double") * 60
            + parts.getItem(2).try_cast("double"))


def duration_fix(create_time, answer_time, recorded) -> Column:
    """When both times are `H:MM:SS`, delta in seconds with one +3600 for a negative delta (Q2);
    otherwise the recorded duration."""
    ct, at = col(create_time), col(answer_time)
    time_only = F.coalesce(ct.rlike(TIME_ONLY_PATTERN), F.lit(False)) & F.coalesce(at.rlike(TIME_ONLY_PATTERN), F.lit(False))
    delta = time_to_seconds(at) - time_to_seconds(ct)
    fixed = F.when(delta < 0, delta + 3600).otherwise(delta)
    return F.when(time_only, fixed).otherwise(to_number(recorded))


def normalize_id(c) -> Column:
    """Trim; `123.0` -> `123` for digit ids; strip one pair of matching quotes; missing -> ''."""
    s = F.coalesce(strip(c), F.lit(""))
    s = F.regexp_replace(s, r"^(\d*)\.0$", "$1")
    quoted = (s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))
    inner = F.when(F.length(s) >= 2, s.substr(F.lit(2), F.length(s) - 2)).otherwise(F.lit(""))
    return F.when(quoted, strip(inner)).otherwise(s)


def looks_like_id(c, prefix: str = ID_PREFIX, min_len: int = ID_MIN_LEN) -> Column:
    """Case-blind prefix and minimum length."""
    s = F.lower(col(c))
    return F.coalesce(s.startswith(prefix) & (F.length(s) >= min_len), F.lit(False))
