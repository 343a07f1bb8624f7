"""Agenda pages of each site: sitemap and navigation, or the site page itself."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.urls import is_sub_sitemap, path_matches_agenda
from affiche.operators.dedup import first_per
from affiche.operators.links import agenda_links, nav_links
from affiche.sources import manifest
from affiche.sources.pages import sitemap_locations, sitemap_url
from affiche.sources.settle import written

AGENDA = "seed string, page_url string"


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, n: int | None = None, levels: int = 1) -> DataFrame:
    """(root, page_url): agenda pages named by each root sitemap or by the sitemaps listed below it.

    ``levels`` says how many levels of listed sitemaps are followed (0: only the roots). Each level is one step
    over pairs (root, sitemap) that were not reached before, so sitemaps that list each other, or are
    listed many times, end there; every sitemap is read once, whichever roots lead to it, or none.

    With ``n`` no more than the first ``n`` pages of a sitemap are followed. That is
    exact where the first ``n`` by URL are asked for in the end, and a sitemap listed by
    many others is then not multiplied by its whole length.
    """
    loc = F.col("loc")
    # Every sitemap is read once, where it lies, and only its short entries are kept: following a level meets no XML.
    # (Written unfiltered: a filter would work every entry's text out once more for each test.)
    entries = written(sitemap_locations(sitemaps.filter("url IS NOT NULL")).drop("loc_ix").withColumn("is_sitemap", is_sub_sitemap(loc)))
    listed = entries.filter("is_sitemap").select("url", "loc")
    frontier = written(roots.select("root", F.col("root").alias("url")).distinct())
    reached = frontier
    for _ in range(levels):
        below = frontier.join(listed, "url").select("root", loc.alias("url")).distinct()
        frontier = written(below.join(reached, ["root", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    named = entries.filter(~F.col("is_sitemap") & path_matches_agenda(loc)).select("url", loc.alias("page_url")).distinct()
    return reached.join(cap_pages(named, "url", n=n), "url").select("root", "page_url").distinct()


def cap_pages(found: DataFrame, *site: str, n: int | None = lexicon.MAX_PAGES_PER_SITE) -> DataFrame:
    """The first ``n`` pages of each site by URL; all of them if ``n`` is None."""
    return found if n is None else first_per(found, list(site), ["page_url"], n)


def with_fallback(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, page_url): the pages found; a seed for which there are none stands for itself."""
    return seeds.join(found, "seed", "left").select(
        "seed", F.coalesce("page_url", "seed").alias("page_url")
    )


def site_urls(sites: DataFrame) -> DataFrame:
    """(seed): the URL of each site once, written, so that Spark knows their size and broadcasts them if they are
    small, however the site table came about."""
    return written(sites.select(F.col("url").alias("seed")).distinct())


def agenda_candidates(
    seeds: DataFrame,
    pages: DataFrame,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = None,
    sitemap_levels: int = 1,
) -> DataFrame:
    """(seed, page_url): agenda pages that site pages and sitemaps lead to, before any are cut.

    With ``max_pages`` sitemap pages are cut to that many per sitemap before they meet the sites.
    """
    site_pages = pages.join(seeds.select(F.col("seed").alias("url")), "url", "left_semi")
    found = (
        agenda_links(nav_links(site_pages))
        .select(F.col("url").alias("seed"), F.col("link_url").alias("page_url"))
        .distinct()
    )
    if sitemaps is None:
        return found
    rooted = seeds.withColumn("root", sitemap_url(F.col("seed")))
    listed = cap_pages(sitemap_pages(sitemaps, rooted, max_pages, sitemap_levels), "root", n=max_pages)
    return found.union(rooted.join(listed, "root").select("seed", "page_url")).distinct()


def discover(
    sites: DataFrame,
    pages: DataFrame,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = lexicon.MAX_PAGES_PER_SITE,
    sitemap_levels: int = 1,
) -> DataFrame:
    """(seed, page_url): at most ``max_pages`` agenda pages per site URL, the first by URL; all with ``None``.

    Only site pages are parsed here. Sitemap pages are cut to ``max_pages`` per sitemap before
    they meet the sites: the first ones of a union lie within the first ones of its parts,
    and a host shared by many sites is not multiplied by its whole sitemap.
    """
    seeds = site_urls(sites)
    found = agenda_candidates(seeds, pages, sitemaps, max_pages, sitemap_levels)
    return with_fallback(seeds, cap_pages(found, "seed", n=max_pages))


def known_agenda(
    path: str,
    load_id: str,
    pages: DataFrame,
    sites: DataFrame,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = lexicon.MAX_PAGES_PER_SITE,
) -> DataFrame:
    """(seed, page_url): agenda pages of each site, from its site page now or from the last one seen before.

    The agenda of all sites so far is kept under ``path``, written anew by each load and listed like the loads of a
    store (``manifest``), so a load reads one folder however many there were. A load that is run again starts from
    what was known before it. A site whose page is among ``pages`` goes by that page alone.
    """
    spark = pages.sparkSession
    now = written(discover(sites, pages, sitemaps, max_pages))
    seen = pages.select(F.col("url").alias("seed")).join(sites.select(F.col("url").alias("seed")), "seed", "left_semi")
    seen = written(seen.distinct())
    number = (manifest.numbers(spark, path) or [0])[-1]
    loads = list(manifest.read(spark, path).loads) if number else []
    earlier = [load for load in loads if load_id not in load.load_ids]
    before = spark.createDataFrame([], AGENDA)
    if earlier:
        before = spark.read.schema(AGENDA).parquet(f"{path}/rows/{earlier[-1].folder}").join(seen, "seed", "left_anti")
    folder = f"{quote(load_id, safe='')}-{uuid.uuid4().hex[:12]}"
    now.join(seen, "seed", "left_semi").union(before).write.parquet(f"{path}/rows/{folder}")
    # The two newest are enough: one to start from, one to start from when the newest load is run again.
    manifest.publish(spark, path, number + 1, [*earlier, manifest.Load(folder, (load_id,), 0, 0)][-2:])
    # Capped once more: a site without its page may still have pages from a sitemap.
    return written(cap_pages(now.union(before).distinct(), "seed", n=max_pages))
