"""Numeric clean-up, rounding and repeatable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader of data frames takes as missing.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# The longest number that a text starts with.
_LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def nan_to_null(value: Column) -> Column:
    """NaN and missing are one thing here, so averages skip both."""
    return F.nullif(value, F.lit(float("nan")))


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TOKENS), text)


# A number as data files write it; a cast alone would also take 1.5d and 2f.
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def is_number(text: Column) -> Column:
    """Whether a text is a plain decimal number."""
    return text.rlike(_NUMBER)


def as_number(text: Column) -> Column:
    """Text to double; anything that is no number becomes NULL, one too large infinity."""
    return F.when(is_number(text), F.trim(text).try_cast("double"))


def finite(number: Column) -> Column:
    """The number, or NULL where it is infinite: infinity would turn every mean into infinity."""
    return F.when(F.abs(number) < float("inf"), number)


def whole(number: Column) -> Column:
    """The number as int, or NULL where it is no whole number of that range."""
    return F.when(number.try_cast("int") == number, number.try_cast("int"))


def to_measure(text: Column) -> Column:
    """Text to double; anything that is no finite number becomes NULL, ``1e400`` too.

    Takes the text apart twice. Where there are many columns, let one projection make the numbers
    (`as_number`) and the next one judge them.
    """
    return finite(as_number(text))


def to_whole_number(text: Column) -> Column:
    """Text to int, also from ``4.0``; NULL where it is no whole number."""
    return whole(as_number(text))


def lenient_number(text: Column) -> Column:
    """The number a text starts with, or 0.0 where there is none (``"12abc"`` is 12)."""
    number = F.regexp_extract(text, _LEADING_NUMBER, 1).try_cast("double")
    # Adding zero turns -0.0 into 0.0.
    return F.coalesce(number, F.lit(0.0)) + F.lit(0.0)


def round_half_up(value: Column) -> Column:
    """Round to a whole number, halves towards positive infinity."""
    return F.floor(value + F.lit(0.5))


def round_shown(value: Column, digits: int) -> Column:
    """Round to the nearest decimal, judged by the binary value: 2.675 to 2.67, 0.125 to 0.12.

    `round` and `bround` judge by the shortest text of a number, which can look like a half where
    the number itself lies above or below it. That distance is computed exactly here, by
    multiplying the number in two halves that lose no bits.
    """
    scale = 10.0 ** (digits + 1)
    near = F.round(value * scale)
    looks_half = (near / scale == value) & (F.abs(near) % 10 == 5)
    spread = value * 134217729.0
    upper = spread - (spread - value)
    distance = (upper * scale - near) + (value - upper) * scale
    return F.when(looks_half & (distance != 0), (near + F.signum(distance) * 5) / scale).otherwise(
        F.bround(value, digits)
    )


def to_percent(share: Column) -> Column:
    """0.9123 to 91.2."""
    return round_shown(share * 100, 1)


def repeatable_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on partition or retry."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)
