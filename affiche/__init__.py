"""Listings of children's activities built from stored web pages, as Spark jobs.

``functions``  column expressions (text, dates, prices, ages, URLs, display)
``sources``    site registry, page snapshots, sitemaps, the activity store
``operators``  DataFrame steps (links, event blocks, filters, rollups, dedup, paging)
``plans``      whole jobs put together from the operators
``streaming``  incremental load of new page snapshots
"""
