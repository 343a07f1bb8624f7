"""A whole run: snapshots in, new activities in the table, counts out."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation

from affiche.functions import lexicon
from affiche.operators.discovery import known_agenda
from affiche.plans.build import build_activities
from affiche.sources.pages import newest, successful
from affiche.sources.store import append, init_store


class LoadCounts(NamedTuple):
    """Rows found on the pages, left after the dedup, and new in the table."""

    found: int
    unique: int
    stored: int


def load_activities(
    pages: DataFrame,
    sites: DataFrame,
    store: str,
    load_id: str,
    as_of: dt.date | None = None,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = lexicon.MAX_PAGES_PER_SITE,
    agenda_path: str | None = None,
) -> LoadCounts:
    """Build the activities of a crawl and store what is new; the counts come with the same pass.

    Of a page that was fetched several times (``fetched_at``) the newest successful snapshot counts.
    With ``agenda_path`` the agenda pages of each site are kept there, for loads in which they come
    without their site page.
    """
    init_store(pages.sparkSession, store)
    found, unique = Observation(), Observation()
    pages = newest(successful(pages))
    agenda = known_agenda(agenda_path, load_id, pages, sites, sitemaps, max_pages) if agenda_path else None
    batch = build_activities(pages, sites, as_of, sitemaps, (found, unique), max_pages, agenda)
    stored = append(store, batch, load_id)
    return LoadCounts(found.get["rows"], unique.get["rows"], stored)
