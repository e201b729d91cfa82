"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.constants import CLIP, DATE_PATTERN, MISSING_LABEL


def parse_date(text: Column, pattern: str = DATE_PATTERN) -> Column:
    """Day-first date text; the single-letter pattern takes padded and unpadded days."""
    return F.to_date(text, pattern)


def first_word(text: Column) -> Column:
    """Everything before the first space; a leading space gives ''."""
    return F.substring_index(text, " ", 1)


def group_word(name: Column) -> Column:
    """First word of a category name; a missing name counts as its own word."""
    return first_word(F.coalesce(name.cast("string"), F.lit(MISSING_LABEL)))


def city_word(name: Column) -> Column:
    """First word of a shop name without exclamation marks."""
    return first_word(F.replace(name, F.lit("!"), F.lit("")))


def clip(value: Column, bounds: tuple[float, float] = CLIP) -> Column:
    low, high = bounds
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def discount_rate(price: Column, reference: Column) -> Column:
    """``1 - price / reference``; NULL, not an error, where the reference is zero."""
    return F.lit(1.0) - F.try_divide(price, reference)
