"""From page snapshots to clean activity rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.classify import (
    is_family,
    is_institutional,
    is_past,
    is_punctual,
    looks_like_event_title,
    title_text,
)
from affiche.functions.text import age_bounds, clock_time, french_date, matching_form, price_label, strip
from affiche.operators.blocks import event_items, summary
from affiche.operators.dedup import CRAWL_ORDER, first_activities
from affiche.operators.discovery import discover
from affiche.schema import NEW_ACTIVITY
from affiche.sources.settle import written


def family_events(items: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Keep the items that are coming one-off family events and add date, time, price, ages.

    ``items`` need title and full_text. Cheap tests on the short title come first;
    the text is brought into matching form once and searched together with the
    title: no listed word contains a line break.
    """
    as_of = as_of or dt.date.today()
    titled = (
        items.withColumn("__title", title_text(F.col("title")))
        .withColumn("__normal_title", matching_form(F.col("title")))
        .withColumn("__stripped_title", strip(F.col("__normal_title")))
        .filter(looks_like_event_title(F.col("__title"), F.col("__stripped_title")))
        .withColumn("__normal_text", matching_form(F.col("full_text")))
        .withColumn("__searched", F.concat_ws("\n", "__normal_title", "__normal_text"))
    )
    searched = F.col("__searched")
    # The shortest list first: a text it finds nothing in is not searched for the longer ones.
    events = titled.filter(is_punctual(searched) & is_family(searched) & ~is_institutional(searched))
    dated = events.withColumn("event_date", french_date(F.col("full_text"))).filter(
        ~is_past(F.col("__normal_title"), F.col("event_date"), as_of)
    )
    return (
        dated.withColumn("event_time", clock_time(F.col("full_text")))
        .withColumn("price", price_label(F.col("__normal_text")))
        .withColumn("__ages", age_bounds(F.col("full_text")))
        .withColumns({"age_min": F.get("__ages", F.lit(0)), "age_max": F.get("__ages", F.lit(1))})
        .drop("__title", "__normal_title", "__stripped_title", "__normal_text", "__searched", "__ages")
    )


def activity_rows(events: DataFrame) -> DataFrame:
    """The columns of a new activity, plus the crawl order where the input has it."""
    order = [name for name in CRAWL_ORDER if name in events.columns and name not in NEW_ACTIVITY.names]
    return events.select(
        strip(F.col("title")).alias("title"),
        strip(F.col("summary")).alias("summary"),
        "link",
        "category",
        F.coalesce("age_min", F.lit(lexicon.DEFAULT_AGE_MIN)).alias("age_min"),
        F.coalesce("age_max", F.lit(lexicon.DEFAULT_AGE_MAX)).alias("age_max"),
        "event_date",
        "event_time",
        "price",
        "city",
        "source_url",
        *order,
    )


def page_events(pages: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Family events of the given pages, one row per event block, without category and city."""
    events = family_events(event_items(pages), as_of)
    return events.withColumn(
        "summary", summary(*map(F.col, ("title", "desc_text", "para_text")))
    ).withColumnRenamed("url", "source_url")


def found_activities(
    pages: DataFrame,
    sites: DataFrame,
    as_of: dt.date | None = None,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = lexicon.MAX_PAGES_PER_SITE,
    agenda: DataFrame | None = None,
) -> DataFrame:
    """All activities found, a page being read once however many sites lead to it.

    The agenda (short rows, at most ``max_pages`` per site) is written: it picks the pages to
    read and later names their sites, and site pages need not be read for both. Its size is then
    known, so a small one is broadcast and no HTML is shuffled. ``agenda`` is one that is known already.
    """
    if agenda is None:
        agenda = written(discover(sites, pages, sitemaps, max_pages))
    wanted = agenda.select(F.col("page_url").alias("url")).distinct()
    events = page_events(pages.join(wanted, "url", "left_semi"), as_of)
    by_site = sites.withColumnRenamed("url", "seed").join(agenda, "seed")
    return activity_rows(
        events.join(by_site.withColumnRenamed("page_url", "source_url"), "source_url")
    )


def build_activities(
    pages: DataFrame,
    sites: DataFrame,
    as_of: dt.date | None = None,
    sitemaps: DataFrame | None = None,
    counts: tuple[Observation, Observation] | None = None,
    max_pages: int | None = lexicon.MAX_PAGES_PER_SITE,
    agenda: DataFrame | None = None,
) -> DataFrame:
    """Activities found on all sites, each title once per city and category.

    ``counts`` takes two observations: rows found, and rows left after the dedup.
    """
    found = found_activities(pages, sites, as_of, sitemaps, max_pages, agenda)
    if counts is None:
        return first_activities(found)
    row = F.count(F.lit(1)).alias("rows")
    return first_activities(found.observe(counts[0], row)).observe(counts[1], row)
