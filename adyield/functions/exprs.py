"""Shared column expressions (JVM-side, codegen friendly; no Python UDFs).

Covers the scalar operators: ratio with guard and clip (P9), clip (F11),
calendar parts (F1-F5), spend-to-budget ratios (F7, F8), type coercions that
follow the pandas rules (T2, T4), and deterministic rounding for comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

# Ratio bounds used throughout the reference.
ROAS_MAX = 50.0
BUDGET_RATIO_MAX = 3.0

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?"
          "|dec(?:ember)?)")
_DAY, _YEAR, _GAP = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})", r"[-/., ]+"
# What stands around the date of a date text: a weekday's name before it, a time with fraction and zone after it.
DATE_HEAD = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[., ]+)?"
DATE_TAIL = (r"(?:(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?|T\d{4}(?:\d{2})?(?:[.,]\d+)?|[T ,]+\d{1,2}(?= *[ap]\.?m)) *(?:[ap]\.?m\.?)?"
             r" *(?:z|[a-z]{2,5}|[a-z]+(?:/[a-z_]+)+)? *(?:[+-]\d{2}:?(?:\d{2})?)? *(?:\([^)]*\))?)?")
# Date layouts tried in this order, as a pattern and the places of year, month and day among its groups (0: the
# first day of the month).
DATE_LAYOUTS = (
    (r"(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})", (1, 2, 3)),     # 2024-01-05, 2024/1/5
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),                     # 20240105
    (rf"(\d{{1,2}})[-/. ](\d{{1,2}})[-/. ]{_YEAR}", (3, 1, 2)),  # 1/5/2024, 01/05/24
    (rf"{_MONTH}{_GAP}{_DAY}{_GAP}{_YEAR}", (3, 1, 2)),          # Jan 5, 2024, Jan-05-2024
    (rf"{_DAY}[-/., ]*{_MONTH}[-/., ]*{_YEAR}", (3, 2, 1)),      # 5-Jan-2024, 05-Jan-24, 5 January 2024
    (rf"(\d{{4}})[-/., ]*{_MONTH}{_GAP}{_DAY}", (1, 2, 3)),      # 2024-Jan-05
    (r"(\d{4})[-/.](\d{1,2})", (1, 2, 0)),                      # 2024-01
    (r"(\d{1,2})[-/.](\d{4})", (2, 1, 0)),                      # 01/2024
    (rf"{_MONTH}[-/., ]*(\d{{4}})", (2, 1, 0)),                  # Jan 2024
    (rf"(\d{{4}})[-/., ]*{_MONTH}", (1, 2, 0)),                  # 2024 Jan
)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL (T2): NaN poisons Spark sums and compares greater than every number."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_double(c: Column | str) -> Column:
    """Any input (string from CSV, number from Parquet) -> double, bad text -> NULL."""
    return nan_to_null(col_(c).try_cast("double"))


def to_long(c: Column | str) -> Column:
    """Truncating float -> int conversion as pandas ``astype(int)`` (T4: via double)."""
    return to_double(c).try_cast("long")


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]. Callers coalesce first: least/greatest skip NULL."""
    c = col_(c)
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    return c


def safe_ratio(num: Column | str, den: Column | str, hi: float = ROAS_MAX) -> Column:
    """num/den when den > 0 else 0; NaN and +-inf (an overflowing quotient) -> 0; then clipped to [0, hi].

    (P9, T1-T3.) The infinity rule is the row-level one: an overflowing
    quotient becomes 0 before the clip, it is not capped at ``hi``.
    """
    num, den = col_(num), col_(den)
    q = F.try_divide(num, den)
    finite = F.when(q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf"))), F.lit(0.0)).otherwise(q)
    return F.when(den > 0, clip(finite, 0.0, hi)).otherwise(F.lit(0.0))


def budget_ratio_feature(spend: Column | str, budget: Column | str) -> Column:
    """spend / daily_budget at feature time.

    The clip happens before the inf/NaN replacement: x/0 with x > 0 gives 3,
    x < 0 gives 0, 0/0 and anything NULL gives 1.
    """
    spend, budget = col_(spend), col_(budget)
    return (
        F.when(spend.isNull() | budget.isNull(), F.lit(1.0))
        .when(budget == 0,
              F.when(spend > 0, F.lit(BUDGET_RATIO_MAX)).when(spend < 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .otherwise(clip(spend / budget, 0.0, BUDGET_RATIO_MAX))
    )


def budget_ratio_forecast(new_spend: Column | str, budget: Column | str) -> Column:
    """new_spend / daily_budget at forecast time (F8): budget <= 0 or NULL -> 1."""
    new_spend, budget = col_(new_spend), col_(budget)
    return F.when((budget > 0) & new_spend.isNotNull(),
                  clip(new_spend / budget, 0.0, BUDGET_RATIO_MAX)).otherwise(F.lit(1.0))


def _layout_date(text: Column, pattern: str, places: tuple[int, int, int], day_first: bool) -> Column:
    """The date that ``text`` holds in one layout, else NULL."""
    whole = f"(?i)^{DATE_HEAD}{pattern}{DATE_TAIL}$"
    year, month, day = (F.regexp_extract(text, whole, k) if k else F.lit("1") for k in places)
    if _MONTH in pattern:
        month = F.array_position(F.lit(MONTHS), F.lower(F.substring(month, 1, 3))).cast("string")
    year = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 69, "20").otherwise("19"), year)).otherwise(year)
    first = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))
    if places == (3, 1, 2) and _MONTH not in pattern:
        # day and month change places where the text can be read no other way
        other = F.try_to_timestamp(F.concat_ws("-", year, day, month), F.lit("yyyy-M-d"))
        first = F.coalesce(other, first) if day_first else F.coalesce(first, other)
    return F.when(F.regexp_like(text, F.lit(whole)), first)


def _is_plain(text: Column) -> Column:
    """Texts built like 2024-01-05, which need no pattern: most of them, in most exports."""
    return (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")


def is_typed_date(dtype: DataType | None) -> bool:
    return isinstance(dtype, (DateType, TimestampType, TimestampNTZType))


def parse_date(c: Column | str, dtype: DataType | None = None, layouts=DATE_LAYOUTS, day_first: bool = False) -> Column:
    """Raw date -> DateType; unparseable -> NULL.

    Typed inputs are truncated to the day; every text is tried against the layouts, and the day is the one written,
    whatever time or zone follows. ``day_first`` tells how numbers such as 5/1/2024 are read if both ways give a
    date; ``normalize`` takes it from the other dates of the same file.
    """
    c = col_(c)
    if is_typed_date(dtype):
        return F.to_date(c)
    text = F.trim(c.cast("string"))
    found = F.to_date(F.coalesce(*[_layout_date(text, p, k, day_first) for p, k in layouts]))
    return F.when(_is_plain(text), text.try_cast("date")).otherwise(found) if layouts is DATE_LAYOUTS else found


# Digits of a time of day: before or after a colon, or its fraction. No date of any layout has a digit beside a colon.
_CLOCK = r"(?<=[Tt ,])\d{1,2}(?=:)|(?<=:)\d{2}|(?<=:\d{2}[.,])\d+"


def day_text(c: Column | str) -> Column:
    """The trimmed text of a date with all digits of its time of day put to 0: a text of the same date, order and shape, of
    which a table has few however exact its times are."""
    text = F.trim(col_(c).cast("string"))
    return F.when(F.contains(text, F.lit(":")) & (F.length(text) <= SHAPE_LENGTH), F.regexp_replace(text, _CLOCK, "00")).otherwise(text)


_NUMBERS = DATE_LAYOUTS[2]
_NUMERIC_DATE = f"(?i)^{DATE_HEAD}{_NUMBERS[0]}{DATE_TAIL}$"


def other_reading(c: Column | str, date: Column) -> Column:
    """``date``, or the day-first reading of a numeric text such as 5/1/2024."""
    text = F.trim(col_(c).cast("string"))
    return F.when(~_is_plain(text) & F.regexp_like(text, F.lit(_NUMERIC_DATE)), F.to_date(_layout_date(text, *_NUMBERS, True))).otherwise(date)


def date_order(c: Column | str) -> Column:
    """What a numeric date text such as 25/12/2023 tells about its file: 'day' or 'month' stands first, or 'either'; NULL
    for other texts."""
    text = F.trim(col_(c).cast("string"))
    a, b = (F.regexp_extract(text, _NUMERIC_DATE, k).try_cast("int") for k in (1, 2))
    return F.when(_is_plain(text), F.lit(None).cast("string")).when((a > 12) & (b <= 12), "day").when(
        (b > 12) & (a <= 12), "month").when((a <= 12) & (b <= 12), "either")


SHAPE_LENGTH = 200


def text_shape(c: Column | str) -> Column:
    """A text with runs of letters and of digits reduced to one sign each: 'a9/9', for reports of unknown layouts."""
    text = F.substring(F.trim(col_(c).cast("string")), 1, SHAPE_LENGTH)
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), "[0-9]+", "9"), F.lit("(missing)"))


# ---------------------------------------------------------------- calendar

def month(d: Column | str) -> Column:
    return F.month(col_(d)).cast("long")


def iso_week(d: Column | str) -> Column:
    return F.weekofyear(col_(d)).cast("long")


def day_of_week(d: Column | str) -> Column:
    """Monday = 0 (F3): ``weekday``, not ``dayofweek`` (Sunday = 1)."""
    return F.weekday(col_(d)).cast("long")


def quarter(d: Column | str) -> Column:
    return F.quarter(col_(d)).cast("long")


def calendar_columns(d: Column | str, min_date: Column | str) -> dict[str, Column]:
    """The eight calendar features in training order."""
    d = col_(d)
    m = F.month(d)
    return {
        "month": m.cast("long"),
        "week_of_year": iso_week(d),
        "day_of_week": day_of_week(d),
        "quarter": quarter(d),
        "is_q4": m.isin(10, 11, 12).cast("long"),
        "is_november": (m == 11).cast("long"),
        "is_december": (m == 12).cast("long"),
        "days_since_start": F.datediff(d, col_(min_date)).cast("long"),
    }


def capitalize(c: Column | str) -> Column:
    """Python ``str.capitalize``: first letter upper, the rest lower."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


SNAP_DIGITS = 8


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Deterministic half-up rounding used on both sides of oracle comparisons.

    First snap to 8 decimals (removes last-bit noise from a different
    summation order, so an exact decimal half stays a half), then
    ``floor(x * 10^d + 0.5) / 10^d``. Both steps evaluate identically in any
    IEEE engine, unlike ``round`` whose half-way handling differs between
    engines. Very large values are left as they are.
    """
    c = col_(c)
    snap = float(10 ** SNAP_DIGITS)
    scale = float(10 ** digits)
    snapped = F.when(F.abs(c) < F.lit(1e10), F.floor(c * F.lit(snap) + F.lit(0.5)) / F.lit(snap)).otherwise(c)
    return F.when(F.abs(snapped) < F.lit(1e11),
                  F.floor(snapped * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(snapped).cast("double")
