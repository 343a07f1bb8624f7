"""Reads of the activity table: optional filters, checks of the arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.schema import READ_COLUMNS

AGE_LIMITS = (1, 18)
PER_PAGE_LIMITS = (1, 100)
PER_PAGE = 20


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    return df.filter(F.col("category") == category) if category else df


def by_city(df: DataFrame, city: str | None) -> DataFrame:
    """Exact match, accents and case included."""
    return df.filter(F.col("city") == city) if city else df


def by_dates(df: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Text comparison of yyyy-mm-dd; undated rows always stay."""
    day = F.col("event_date")
    if date_from:
        df = df.filter((day >= date_from) | day.isNull())
    if date_to:
        df = df.filter((day <= date_to) | day.isNull())
    return df


def by_age(df: DataFrame, age: int | None) -> DataFrame:
    """The age lies in the range of the row; rows without a range never match."""
    if age is None:
        return df
    return df.filter((F.col("age_min") <= age) & (F.col("age_max") >= age))


def filter_activities(
    df: DataFrame,
    category: str | None = None,
    city: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    age: int | None = None,
) -> DataFrame:
    """Whichever filters are set, all of them plain comparisons that reach the scan."""
    df = by_city(by_category(df, category), city)
    return by_age(by_dates(df, date_from, date_to), age)


def read_view(df: DataFrame) -> DataFrame:
    return df.select(*READ_COLUMNS)


def check_arguments(age: int | None = None, page: int = 1, per_page: int = PER_PAGE) -> None:
    """The limits of the public read; the table functions themselves take any value."""
    if age is not None and not AGE_LIMITS[0] <= age <= AGE_LIMITS[1]:
        raise ValueError(f"age must be between {AGE_LIMITS[0]} and {AGE_LIMITS[1]}, not {age}")
    if page < 1:
        raise ValueError(f"page must be 1 or more, not {page}")
    if not PER_PAGE_LIMITS[0] <= per_page <= PER_PAGE_LIMITS[1]:
        raise ValueError(
            f"per_page must be between {PER_PAGE_LIMITS[0]} and {PER_PAGE_LIMITS[1]}, not {per_page}"
        )
