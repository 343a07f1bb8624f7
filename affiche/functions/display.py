"""Columns of an activity card as a visitor sees it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.text import as_day, blank_to_null


def category_label(category: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in lexicon.CATEGORY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, category), category)


def price_text(price: Column) -> Column:
    return F.coalesce(blank_to_null(price), F.lit(lexicon.PRICE_UNKNOWN))


def is_free(price: Column) -> Column:
    return F.coalesce(F.lower(price) == lexicon.PRICE_FREE.lower(), F.lit(False))


def long_date(event_date: Column, event_time: Column) -> Column:
    """"mer. 15 avril 2026 à 14:00"; '' when neither is known, null day text when not a real day."""
    day = as_day(event_date)
    weekday = F.element_at(F.array(*map(F.lit, lexicon.WEEKDAYS)), F.dayofweek(day))
    month = F.element_at(F.array(*map(F.lit, lexicon.MONTH_NAMES)), F.month(day))
    shown = F.concat_ws(" ", weekday, F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))
    date_part = F.when(F.coalesce(event_date, F.lit("")) == "", "").when(day.isNotNull(), shown)
    time_part = F.when(
        F.coalesce(event_time, F.lit("")) == "", ""
    ).otherwise(F.concat(F.lit(" à "), event_time))
    return F.concat(date_part, time_part)


def age_text(age_min: Column, age_max: Column) -> Column:
    return F.concat(age_min.cast("string"), F.lit("-"), age_max.cast("string"), F.lit(" ans"))


def with_card_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "category_label": category_label(F.col("category")),
            "price_text": price_text(F.col("price")),
            "is_free": is_free(F.col("price")),
            "date_text": long_date(F.col("event_date"), F.col("event_time")),
            "age_text": age_text(F.col("age_min"), F.col("age_max")),
        }
    )


def shown_so_far(total: Column, page: Column, per_page: Column) -> Column:
    """Cards on screen after loading pages 1..page one below the other."""
    return F.least(page.cast("long") * per_page, total)


def has_more(total: Column, page: Column, per_page: Column) -> Column:
    return shown_so_far(total, page, per_page) < total


def counter_text(shown: Column, total: Column) -> Column:
    plural = F.when(total > 1, "s").otherwise("")
    text = F.concat(
        shown.cast("string"), F.lit(" sur "), total.cast("string"), F.lit(" activité"), plural
    )
    return F.when(total > 0, text).otherwise("")
