"""Which sites to read, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl_plan(categories: DataFrame, cities: DataFrame, sites: DataFrame) -> DataFrame:
    """(category, city, url, category_ord, city_ord): every pair of the two lists that has a site.

    A pair without a site yields nothing, so the site table is joined to both lists
    instead of forming all pairs first.
    """
    return (
        sites.select("category", "city", "url")
        .join(categories, "category")
        .join(cities, "city")
        .select("category", "city", "url", "category_ord", "city_ord")
    )


def found_per_site(activities: DataFrame) -> DataFrame:
    return activities.groupBy("category", "city").agg(F.count("*").alias("found"))
