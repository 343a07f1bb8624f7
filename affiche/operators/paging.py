"""Ordered pages of a read, with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.operators.filters import PER_PAGE, check_arguments, filter_activities, read_view
from affiche.operators.rollups import total
from affiche.schema import READ_COLUMNS

# Undated rows first; the id settles ties.
ORDER = ["event_date", "event_time", "id"]


def page_rows(df: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """Rows (page-1)*per_page .. page*per_page of the ordered read; none past the end.

    One plan at every depth: a top-k of offset + per_page rows, which Spark itself turns into a sort where
    that is many. Who reads on and on, or far down, should use ``rows_after``, whose cost does not grow.
    """
    return df.orderBy(*ORDER).offset((page - 1) * per_page).limit(per_page)


def rows_after(
    df: DataFrame, event_date: str | None, event_time: str | None, id: int, per_page: int = PER_PAGE
) -> DataFrame:
    """The next ``per_page`` rows after the row with these order values, which is the last one of a page."""
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(ORDER, (event_date, event_time, id)):
        column = F.col(name)
        # Nulls come first, like in the order itself.
        after = column.isNotNull() if value is None else F.coalesce(column > value, F.lit(False))
        later = later | (same & after)
        same = same & column.eqNullSafe(F.lit(value))
    return df.filter(later).orderBy(*ORDER).limit(per_page)


def read_page(
    df: DataFrame, page: int = 1, per_page: int = PER_PAGE, **filters
) -> tuple[DataFrame, DataFrame]:
    """(page rows, one-row total) of a filtered read: two small jobs on one filtered scan."""
    found = filter_activities(df, **filters)
    return page_rows(read_view(found), page, per_page), total(found)


def response(df: DataFrame, page: int = 1, per_page: int = PER_PAGE, **filters) -> DataFrame:
    """One row: activities (at most ``per_page`` structs, in order), total, page, per_page."""
    check_arguments(filters.get("age"), page, per_page)
    rows, count = read_page(df, page, per_page, **filters)
    entry = F.struct(*ORDER, F.struct(*READ_COLUMNS).alias("activity"))
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["activity"])
    return rows.agg(listed.alias("activities")).select(
        "activities",
        count.scalar().alias("total"),
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
    )
