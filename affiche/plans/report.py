"""A run with its report: what each category and city was read for, what was left out, what came of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.operators.dedup import first_activities
from affiche.operators.discovery import agenda_candidates, cap_pages, site_urls, with_fallback
from affiche.plans.build import found_activities
from affiche.sources import store as activity_store
from affiche.sources.pages import newest, successful
from affiche.sources.settle import written

PLACE = ["category", "city"]
COUNTS = ["sites", "pages", "cut", "unreadable", "found", "unique", "stored"]


def load_with_report(
    pages: DataFrame,
    sites: DataFrame,
    store: str,
    load_id: str,
    as_of: dt.date | None = None,
    sitemaps: DataFrame | None = None,
    max_pages: int = lexicon.MAX_PAGES_PER_SITE,
) -> DataFrame:
    """Load a crawl and return one row for each category and city that has a site, with ``COUNTS``.

    ``pages`` are the agenda pages read, ``cut`` those left out because a site has more than ``max_pages``,
    ``unreadable`` the pages read that have no good snapshot with HTML, ``found`` the events on them, ``unique`` what is
    left of those after the dedup, ``stored`` what was new in the table. A page that several sites lead to counts for each.
    To count what is cut, sitemaps are listed whole here. The rows are computed from tables that are written once;
    no page is read twice.
    """
    spark = pages.sparkSession
    pages = newest(successful(pages))
    seeds = site_urls(sites)
    candidates = written(agenda_candidates(seeds, pages, sitemaps))
    agenda = written(with_fallback(seeds, cap_pages(candidates, "seed", n=max_pages)))
    found = written(found_activities(pages, sites, as_of, agenda=agenda))
    unique = written(first_activities(found))
    activity_store.append(store, unique, load_id)

    placed = sites.select(*PLACE, F.col("url").alias("seed"))
    wanted = agenda.select(F.col("page_url").alias("url")).distinct()
    good = pages.filter("html IS NOT NULL").select("url").join(wanted, "url", "left_semi").distinct()
    missing = agenda.join(good.withColumnRenamed("url", "page_url"), "page_url", "left_anti")
    more = F.greatest(F.count("*") - max_pages, F.lit(0))
    counted = {
        "sites": placed,
        "pages": placed.join(agenda, "seed"),
        "cut": placed.join(candidates.groupBy("seed").agg(more.alias("n")), "seed"),
        "unreadable": placed.join(missing, "seed"),
        "found": found,
        "unique": unique,
        "stored": activity_store.read_load(spark, store, load_id),
    }
    parts = [
        rows.select(*PLACE, F.lit(name).alias("kind"), (F.col("n") if name == "cut" else F.lit(1)).cast("long").alias("n"))
        for name, rows in counted.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    # Seven counts of each pair, added up in each task before anything is shuffled.
    report = every.groupBy(*PLACE).agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(name) for name in COUNTS]
    )
    return written(report)
