"""First-wins rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affiche.functions.text import dedup_title

CRAWL_ORDER = ["category_ord", "city_ord", "source_url", "item_ix"]


def first_per(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark cuts every key to ``n`` rows per task before the shuffle, so a key that
    holds a third of all rows sends ``n`` rows per task, not a third of the table.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def first_activities(df: DataFrame, order: Sequence[Column | str] = CRAWL_ORDER) -> DataFrame:
    """One row per title, city and category, whatever its date: the first in crawl order."""
    return first_per(
        df.withColumn("__title", dedup_title(F.col("title"))), ["__title", "city", "category"], order
    ).drop("__title")
