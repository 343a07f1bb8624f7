"""Counts and lists over the activity table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def count_by(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("cnt"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct().orderBy(name)


def with_configured(df: DataFrame, configured: DataFrame, name: str) -> DataFrame:
    """Stored values and configured ones, each once, sorted by code point."""
    return df.select(name).distinct().union(configured.select(name)).distinct().orderBy(name)


def status_counts(df: DataFrame) -> DataFrame:
    """(scope, name, cnt) for the whole table, each category, each city.

    The table is counted once per (category, city); the grouping sets run on that
    small result, so no row of the table is tripled. An empty table has no counts.
    """
    return counts_of_cells(df.groupBy("category", "city").agg(F.count("*").alias("n")))


def counts_of_cells(cells: DataFrame) -> DataFrame:
    """The same from the counts (category, city, n), as a store keeps them with each load."""
    sets = cells.groupingSets([[], ["category"], ["city"]], "category", "city").agg(
        F.sum("n").alias("cnt"),
        F.grouping("category").alias("all_categories"),
        F.grouping("city").alias("all_cities"),
    )
    scope = (
        F.when((F.col("all_categories") == 1) & (F.col("all_cities") == 1), "total")
        .when(F.col("all_categories") == 0, "category")
        .otherwise("city")
    )
    return sets.select(scope.alias("scope"), F.coalesce("category", "city").alias("name"), "cnt")


def status_report(df: DataFrame) -> DataFrame:
    """One row: total_activities and the two maps name -> count.

    The maps hold one entry per category and per city, never per activity.
    """
    return report_of_counts(status_counts(df))


def report_of_counts(counts: DataFrame) -> DataFrame:
    """The same row from (scope, name, cnt)."""

    def as_map(scope: str):
        # collect_list leaves out the nulls of the other scopes
        entry = F.when(F.col("scope") == scope, F.struct("name", "cnt"))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    return counts.agg(
        F.coalesce(F.max(F.when(F.col("scope") == "total", F.col("cnt"))), F.lit(0)).alias(
            "total_activities"
        ),
        as_map("category").alias("by_category"),
        as_map("city").alias("by_city"),
    )


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return df.isEmpty()
