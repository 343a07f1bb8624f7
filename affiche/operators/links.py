"""Links of a page that may lead to its agenda."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.functions.urls import (
    is_followable,
    on_same_site,
    path_matches_agenda,
    text_matches_agenda,
)
from affiche.operators.dedup import first_per
from affiche.sources.pages import page_links

ELSEWHERE = 2  # the zone outside navigation


def followable_links(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_links`` without anchors, script calls and empty links."""
    return page_links(pages, partitions).filter(is_followable(F.col("href")))


def first_links(links: DataFrame) -> DataFrame:
    """Each link once per page: navigation before the rest, then page order."""
    return first_per(links, ["page_id", "link_url"], ["zone", "link_ix"])


def nav_links(pages: DataFrame) -> DataFrame:
    """Links in navigation, and links elsewhere whose path names an agenda; each once per page."""
    links = followable_links(pages)
    wanted = (F.col("zone") < ELSEWHERE) | path_matches_agenda(F.col("link_url"))
    return first_links(links.filter(wanted))


def agenda_links(links: DataFrame) -> DataFrame:
    """Of ``nav_links``: those on the same site whose path or text names an agenda."""
    link, base = F.col("link_url"), F.col("url")
    return links.filter(
        (path_matches_agenda(link) | text_matches_agenda(F.col("text"))) & on_same_site(link, base)
    )
