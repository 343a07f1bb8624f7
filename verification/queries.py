"""The checked queries: every operator over whole tables, one entry each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affiche.functions import classify, display, in_sql, text, urls
from affiche.operators import blocks, dedup, discovery, filters, links, paging, ranks, rollups
from affiche.plans import build, crawl, report
from affiche.plans.load import load_activities
from affiche.schema import NEW_ACTIVITY
from affiche.sources import pages as page_source
from affiche.sources import registry, settle, snapshots, store
from affiche.streaming.incremental import load_snapshots
from verification import views
from verification.views import DATE_AS_OF, YEAR_AS_OF, listings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, shared by all executors."""
    settle.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/check-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- reads


@query
def activities_page(spark, sf_dir):
    rows, _ = paging.read_page(
        views.activities(spark, sf_dir),
        page=2,
        category="library",
        city="NATION_7",
        date_from="1997-01-01",
        date_to="2000-12-31",
        age=7,
    )
    return rows


@query
def activities_total(spark, sf_dir):
    _, total = paging.read_page(
        views.activities(spark, sf_dir), category="library", date_from="1997-01-01", age=7
    )
    return total


@query
def deep_page(spark, sf_dir):
    """Page 101 of the table."""
    return paging.page_rows(filters.read_view(views.activities(spark, sf_dir)), page=101, per_page=100)


@query
def rows_after(spark, sf_dir):
    """The 200 rows after a given one: a page far down without an offset."""
    rows = filters.read_view(views.activities(spark, sf_dir))
    return paging.rows_after(rows, "1996-05-01", "14:30", 1_000, per_page=200)


@query
def filter_category(spark, sf_dir):
    return filters.by_category(views.activities(spark, sf_dir), "mjc").select("id", "category")


@query
def filter_city(spark, sf_dir):
    return filters.by_city(views.activities(spark, sf_dir), "NATION_3").select("id", "city")


@query
def filter_dates(spark, sf_dir):
    found = filters.by_dates(views.activities(spark, sf_dir), "1996-05-01", "1999-03-31")
    return found.select("id", "event_date")


@query
def filter_age(spark, sf_dir):
    return filters.by_age(views.activities(spark, sf_dir), 11).select("id", "age_min", "age_max")


@query
def read_view(spark, sf_dir):
    return filters.read_view(views.activities(spark, sf_dir))


@query
def response_envelope(spark, sf_dir):
    answer = paging.response(views.activities(spark, sf_dir), page=3, per_page=50, city="NATION_7")
    return answer.withColumn("activities", F.to_json("activities"))


# ---------------------------------------------------------------- lists and counts


@query
def distinct_cities(spark, sf_dir):
    return rollups.distinct_values(views.activities(spark, sf_dir), "city")


@query
def distinct_categories(spark, sf_dir):
    return rollups.distinct_values(views.activities(spark, sf_dir), "category")


@query
def cities_union(spark, sf_dir):
    return rollups.with_configured(views.activities(spark, sf_dir), registry.cities(spark), "city")


@query
def categories_union(spark, sf_dir):
    return rollups.with_configured(views.activities(spark, sf_dir), registry.categories(spark), "category")


@query
def count_by_category(spark, sf_dir):
    return rollups.count_by(views.activities(spark, sf_dir), "category")


@query
def count_by_city(spark, sf_dir):
    return rollups.count_by(views.activities(spark, sf_dir), "city")


@query
def status_counts(spark, sf_dir):
    return rollups.status_counts(views.activities(spark, sf_dir))


@query
def status_report(spark, sf_dir):
    report = rollups.status_report(views.activities(spark, sf_dir))
    return report.withColumns({name: F.to_json(name) for name in ("by_category", "by_city")})


# ---------------------------------------------------------------- text


@query
def parse_date(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_id", text.french_date(F.col("date_text")).alias("event_date")
    )


@query
def parse_time(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_id", text.clock_time(F.col("time_text")).alias("event_time")
    )


@query
def parse_price(spark, sf_dir):
    normal = listings(spark, sf_dir).withColumn("n", text.matching_form(F.col("price_text")))
    return normal.select("row_id", text.price_label(F.col("n")).alias("price"))


@query
def parse_age(spark, sf_dir):
    ages = listings(spark, sf_dir).select("row_id", text.age_range(F.col("age_text")).alias("ages"))
    return ages.select("row_id", "ages.age_min", "ages.age_max")


@query
def parse_documents(spark, sf_dir):
    whole = F.col("text")
    return (
        table(spark, sf_dir, "documents")
        .withColumn("n", text.matching_form(whole))
        .withColumn("ages", text.age_bounds(whole))
        .select(
            "doc_id",
            text.french_date(whole).alias("event_date"),
            text.clock_time(whole).alias("event_time"),
            text.price_label(F.col("n")).alias("price"),
            F.get("ages", F.lit(0)).alias("age_min"),
            F.get("ages", F.lit(1)).alias("age_max"),
        )
    )


@query
def normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.matching_form(F.col("text")).alias("normal_text")
    )


@query
def normalise_titles(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_id",
        text.matching_form(F.col("title")).alias("normal_title"),
        text.dedup_title(F.col("title")).alias("dedup_title"),
    )


@query
def summary_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.summary_cut(F.col("text")).alias("summary")
    )


@query
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.scheme(url).alias("scheme"),
        urls.host(url).alias("host"),
        urls.path(url).alias("path"),
    )


# ---------------------------------------------------------------- classifiers


def _rules(df: DataFrame, column: str, *keys: str, verdict: bool = False) -> DataFrame:
    prepared = df.withColumns(
        {"s": classify.title_text(F.col(column)), "n": text.strip(text.matching_form(F.col(column)))}
    )
    flags = [rule.alias(name) for name, rule in classify.title_rejections(F.col("s"), F.col("n")).items()]
    if verdict:
        flags.append(classify.looks_like_event_title(F.col("s"), F.col("n")).alias("is_title"))
    return prepared.select(*keys, *flags)


@query
def title_rules(spark, sf_dir):
    return _rules(listings(spark, sf_dir), "title", "row_id", verdict=True)


@query
def title_rules_conversations(spark, sf_dir):
    return _rules(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


def _matching_texts(spark, sf_dir, rule) -> DataFrame:
    """Ids of the whole documents, conversation turns and listings a rule finds something in."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text"
    )
    rows = listings(spark, sf_dir).select(F.lit("listings"), "row_id", views.full_text())
    normal = documents.union(turns).union(rows).withColumn("n", text.matching_form(F.col("text")))
    return normal.filter(rule(F.col("n"))).select("source", "id")


@query
def excluded(spark, sf_dir):
    return _matching_texts(spark, sf_dir, classify.is_institutional)


@query
def punctual(spark, sf_dir):
    return _matching_texts(spark, sf_dir, classify.is_punctual)


@query
def family(spark, sf_dir):
    return _matching_texts(spark, sf_dir, classify.is_family)


@query
def content_flags(spark, sf_dir):
    normal = listings(spark, sf_dir).withColumn("n", text.matching_form(views.full_text()))
    n = F.col("n")
    return normal.select(
        "row_id",
        classify.is_institutional(n).alias("excluded"),
        classify.is_punctual(n).alias("punctual"),
        classify.is_family(n).alias("family"),
    )


@query
def past(spark, sf_dir):
    titled = views.activities(spark, sf_dir).withColumn("n", text.matching_form(F.col("title")))
    undated = F.lit(None).cast("string")
    return titled.select(
        "id",
        classify.is_past(F.col("n"), F.col("event_date"), DATE_AS_OF).alias("past_by_date"),
        classify.is_past(F.col("n"), undated, YEAR_AS_OF).alias("past_by_title"),
    )


@query
def classify_pipeline(spark, sf_dir):
    items = listings(spark, sf_dir).withColumn("full_text", views.full_text())
    return build.family_events(items, DATE_AS_OF).select(
        "row_id", text.strip(F.col("title")).alias("title"), "category", "city", "source_url",
        "event_date", "event_time", "price", "age_min", "age_max",
    )


@query
def classify_in_sql(spark, sf_dir):
    """``classify_pipeline`` as one SQL statement over the registered functions."""
    in_sql.register(spark, DATE_AS_OF)
    return spark.sql(
        """WITH titled AS (SELECT *, title_text(title) AS shown, matching_form(title) AS normal_title FROM {items}),
        texts AS (SELECT *, matching_form(full_text) AS normal_text FROM titled
          WHERE is_event_title(shown, strip_spaces(normal_title))),
        searched AS (SELECT *, concat_ws('\n', normal_title, normal_text) AS both FROM texts),
        events AS (SELECT *, french_date(full_text) AS event_date FROM searched
          WHERE is_punctual(both) AND is_family(both) AND NOT is_institutional(both)),
        coming AS (SELECT *, age_range(full_text) AS ages FROM events WHERE NOT is_past(normal_title, event_date))
        SELECT row_id, strip_spaces(title) AS title, category, city, source_url, event_date,
          clock_time(full_text) AS event_time, price_label(normal_text) AS price, ages.age_min, ages.age_max FROM coming""",
        items=listings(spark, sf_dir).withColumn("full_text", views.full_text()),
    )


# ---------------------------------------------------------------- dedup and load


@query
def first_wins_dedup(spark, sf_dir):
    return dedup.first_activities(listings(spark, sf_dir), ["row_id"]).select(
        "row_id", "title", "city", "category"
    )


@query
def required_rows(spark, sf_dir):
    # Customers in debt have no segment here, so required values are missing all over the table.
    customers = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    named = rows.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.lit("x").alias("city"),
        F.lit("x").alias("source_url"),
    )
    return store.complete_rows(named).select(
        "o_orderkey", F.col("title").alias("o_orderstatus"), F.col("category").alias("c_mktsegment")
    )


def _insert(spark, sf_dir, null_safe: bool) -> DataFrame:
    """Everything is offered again; what orders before 1998 gave is stored already."""
    offered = views.activities(spark, sf_dir)
    early = table(spark, sf_dir, "orders").filter("o_orderdate < '1998-01-01'").select(
        F.col("o_orderkey").alias("id")
    )
    stored = offered.join(early, "id", "left_semi")
    return store.insert_if_absent(offered, stored, null_safe, order=["id"]).select(
        "id", "title", "event_date", "city", "source_url"
    )


@query
def insert_if_absent(spark, sf_dir):
    return _insert(spark, sf_dir, null_safe=False)


@query
def insert_if_absent_null_safe(spark, sf_dir):
    return _insert(spark, sf_dir, null_safe=True)


_STORED = ["title", "event_date", "event_time", "price", "city", "source_url", "category", "age_min", "age_max"]


@query
def insert_into_store(spark, sf_dir):
    """One load into an empty store: dated rows once per key, the one with the smallest id; undated rows all."""
    path = scratch(spark)
    store.append(path, views.activities(spark, sf_dir).withColumnRenamed("id", "row_id"), "first", order=["row_id"])
    return store.read_store(spark, path).select(*_STORED)


@query
def insert_twice(spark, sf_dir):
    """Orders before 1996 are stored, then everything is offered: undated rows of the first load come again."""
    path = scratch(spark)
    early = views.activities(spark, sf_dir, views.orders_of_days(spark, sf_dir, "1996-01-01"))
    for name, offered in (("first", early), ("second", views.activities(spark, sf_dir))):
        store.append(path, offered.withColumnRenamed("id", "row_id"), name, order=["row_id"])
    return store.read_store(spark, path).select(*_STORED)


# ---------------------------------------------------------------- crawl


@query
def crawl_plan(spark, sf_dir):
    sites = listings(spark, sf_dir).groupBy("category", "city").agg(F.min("source_url").alias("url"))
    cities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.col("n_nationkey").alias("city_ord"))
    return crawl.crawl_plan(registry.categories(spark), cities, sites)


@query
def page_links(spark, sf_dir):
    found = links.followable_links(table(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism)
    return found.select(
        "page_id", "link_ix", "link_url", "text", "zone"
    )


@query
def links_in_sql(spark, sf_dir):
    """``page_links`` by the table function, with the hosts and paths that SQL functions cut from the links."""
    in_sql.register(spark, DATE_AS_OF)
    return spark.sql(
        """SELECT page_id, link_ix, link_url, l.text, zone, url_host(link_url) AS link_host, is_same_site(link_url, url) AS same_site
        FROM {pages}, LATERAL page_links(url, html) AS l WHERE is_followable(href)""",
        pages=table(spark, sf_dir, "pages").repartition(spark.sparkContext.defaultParallelism),
    )


@query
def absolute_urls(spark, sf_dir):
    base, page_id = F.col("url"), F.col("page_id").cast("string")
    origin_free = F.concat(F.lit("//autre.example/a/../"), F.lit("x"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.absolute_url(base, F.concat(F.lit("/x/../agenda/./"), page_id)).alias("rooted"),
        urls.absolute_url(base, F.lit("suite.html?p=2")).alias("beside"),
        F.replace(urls.absolute_url(base, origin_free), F.lit("/a/.."), F.lit("")).alias("elsewhere"),
    )


@query
def link_first_wins(spark, sf_dir):
    found = links.followable_links(table(spark, sf_dir, "pages"))
    return links.first_links(found).select("page_id", "link_ix", "link_url", "text")


@query
def agenda_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").union(views.entry_pages(spark, sf_dir))
    found = links.agenda_links(links.nav_links(pages))
    return found.select("page_id", "link_url")


@query
def nav_zones(spark, sf_dir):
    return links.nav_links(views.entry_pages(spark, sf_dir)).select("page_id", "link_url", "text", "zone")


@query
def page_cap(spark, sf_dir):
    found = listings(spark, sf_dir).select(
        "city", F.concat_ws("/", "source_url", F.col("row_id").cast("string")).alias("page_url")
    )
    return discovery.cap_pages(found.distinct(), "city")


@query
def fallback_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    found = pages.join(good, "page_id", "left_semi").select(
        F.col("url").alias("seed"), F.concat("url", F.lit("/agenda")).alias("page_url")
    )
    return discovery.with_fallback(pages.select(F.col("url").alias("seed")), found)


@query
def discover_pages(spark, sf_dir):
    return discovery.discover(views.order_sites(spark, sf_dir), views.entry_pages(spark, sf_dir))


@query
def sitemap_locs(spark, sf_dir):
    return page_source.sitemap_locations(views.sitemaps(spark, sf_dir))


@query
def sitemap_pages(spark, sf_dir):
    roots = views.order_sites(spark, sf_dir).select(page_source.sitemap_url(F.col("url")).alias("root"))
    return discovery.sitemap_pages(views.sitemaps(spark, sf_dir), roots)


@query
def discover_with_sitemaps(spark, sf_dir):
    return discovery.discover(
        views.order_sites(spark, sf_dir), views.entry_pages(spark, sf_dir), views.sitemaps(spark, sf_dir)
    )


# ---------------------------------------------------------------- blocks and items


def _elements(spark, sf_dir) -> DataFrame:
    """Line items stand in for page elements: the order for the page, the return flag for the class."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_returnflag").alias("class_key"),
        F.col("l_linenumber").alias("ix"),
        F.round(F.col("l_extendedprice") / 1000).cast("int").alias("chars"),
        (F.col("l_tax") > 0.07).alias("in_nav"),
        (F.col("l_linestatus") == "O").alias("has_heading"),
        (F.col("l_discount") > 0.05).alias("has_link"),
    )


@query
def class_groups(spark, sf_dir):
    return blocks.class_groups(_elements(spark, sf_dir), "l_orderkey").drop("score").withColumn("avg_chars", F.round("avg_chars", 6))


@query
def class_group_best(spark, sf_dir):
    best = blocks.best_class_group(_elements(spark, sf_dir), "l_orderkey")
    return best.select("l_orderkey", "class_key", "n", "first_ix", F.round("score", 4).alias("score"))


def _placed_items(spark, sf_dir) -> DataFrame:
    items = blocks.event_items(views.agenda_pages(spark, sf_dir))
    return items.withColumn("place", F.regexp_extract("link", "ligne=([0-9]+)", 1).cast("int"))


@query
def event_items(spark, sf_dir):
    return _placed_items(spark, sf_dir).select(
        "page_id", "url", "way", "place", "title", "full_text", "link", "desc_text", "para_text"
    )


@query
def item_summary(spark, sf_dir):
    shown = blocks.summary(*map(F.col, ("title", "desc_text", "para_text")))
    return _placed_items(spark, sf_dir).select("page_id", "place", shown.alias("summary"))


@query
def found_per_site(spark, sf_dir):
    return crawl.found_per_site(listings(spark, sf_dir))


@query
def build_activities(spark, sf_dir):
    pages = views.agenda_pages(spark, sf_dir).union(views.entry_pages(spark, sf_dir))
    return build.build_activities(pages, views.order_sites(spark, sf_dir), DATE_AS_OF).select(
        *NEW_ACTIVITY.names
    )


@query
def unreadable_pages(spark, sf_dir):
    """Every tenth page was stored without its HTML; all others can be read."""
    html = F.when(F.col("page_id") % 10 != 3, F.col("html"))
    return page_source.unreadable(table(spark, sf_dir, "pages").withColumn("html", html))


@query
def incremental_load(spark, sf_dir):
    """Agenda pages arrive as snapshot files; the table is read back after the load."""
    folder = scratch(spark)
    pages = views.agenda_pages(spark, sf_dir).union(views.entry_pages(spark, sf_dir))
    pages.withColumn("status", F.lit(200)).write.parquet(f"{folder}/snapshots")
    load_snapshots(
        spark,
        f"{folder}/snapshots",
        views.order_sites(spark, sf_dir),
        f"{folder}/store",
        f"{folder}/progress",
        DATE_AS_OF,
    ).awaitTermination()
    return store.read_store(spark, f"{folder}/store").select(*NEW_ACTIVITY.names)


@query
def incremental_late_page(spark, sf_dir):
    """Site pages come in one run, the agenda pages they lead to in the next, which starts from a fresh checkpoint."""
    folder = scratch(spark)
    sites = views.order_sites(spark, sf_dir)
    for name, pages in (("entry", views.entry_pages(spark, sf_dir)), ("agenda", views.agenda_pages(spark, sf_dir))):
        pages.withColumn("status", F.lit(200)).write.parquet(f"{folder}/{name}")
        load_snapshots(
            spark, f"{folder}/{name}", sites, f"{folder}/store", f"{folder}/progress-{name}", DATE_AS_OF
        ).awaitTermination()
    return store.read_store(spark, f"{folder}/store").select(*NEW_ACTIVITY.names)


# ---------------------------------------------------------------- versions of pages and of the store


@query
def snapshot_status(spark, sf_dir):
    """Each page with one of several HTTP statuses, or none: what counts as fetched."""
    status = F.array(*[F.lit(n) for n in (200, 204, 299, 300, 304, 404, 500, 199, None)])
    pages = table(spark, sf_dir, "pages").withColumn("status", F.element_at(status, (F.col("page_id") % 9 + 1).cast("int")))
    return page_source.successful(pages).select("page_id", "url", "status")


@query
def newest_snapshots(spark, sf_dir):
    """Every page fetched four times, at times that differ or are equal or unknown: the last good fetch of each URL."""
    pages = table(spark, sf_dir, "pages")
    tries = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    page, k = F.col("page_id"), F.col("k")
    day = (page * 7 + k * 5) % 4
    fetched = pages.select("page_id", "url", "html", tries).select(
        (page * 10 + k).alias("page_id"),
        "url",
        "html",
        F.when((page + k) % 6 == 0, 503).otherwise(200).alias("status"),
        F.when((page + k) % 7 != 0, F.timestamp_seconds(F.lit(1_767_225_600) + day * 86_400)).alias("fetched_at"),
    )
    return page_source.newest(page_source.successful(fetched)).select("page_id", "url", F.length("html").alias("n_chars"))


def _crawled_twice(spark, sf_dir) -> DataFrame:
    """Every page twice: an earlier fetch with other events, or for every fifth a later one that failed."""
    pages = views.agenda_pages(spark, sf_dir).union(views.entry_pages(spark, sf_dir))
    event = '<article class="event"><h3>Spectacle ancien numéro {0} en famille</h3><p>le {0}/11/2031 à 15h, tarif 4 €</p></article>'
    other = pages.withColumn("html", F.lit(event.format(3) + event.format(4)))
    failed = F.col("page_id") % 5 == 0
    day = "timestamp'2026-01-{} 06:00:00'".format
    return pages.select("*", F.lit(200).alias("status"), F.expr(day("02")).alias("fetched_at")).union(
        other.select(
            "*",
            F.when(failed, 500).otherwise(200).alias("status"),
            F.when(failed, F.expr(day("03"))).otherwise(F.expr(day("01"))).alias("fetched_at"),
        )
    )


@query
def recrawled_activities(spark, sf_dir):
    """Two crawls of all pages: only what the newer good fetch of each page shows."""
    pages = page_source.newest(page_source.successful(_crawled_twice(spark, sf_dir)))
    return build.build_activities(pages.select("page_id", "url", "html"), views.order_sites(spark, sf_dir), DATE_AS_OF).select(
        *NEW_ACTIVITY.names
    )


@query
def bucketed_activities(spark, sf_dir):
    """The same from snapshots that lie in buckets by URL, stored crawl by crawl."""
    folder, buckets = scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = _crawled_twice(spark, sf_dir)
    second = F.col("fetched_at") == F.expr("timestamp'2026-01-02 06:00:00'")
    for crawl_pages in (twice.filter(~second), twice.filter(second)):
        snapshots.add_snapshots(crawl_pages, folder, buckets)
    pages = snapshots.current(spark, folder, buckets)
    return build.build_activities(pages, views.order_sites(spark, sf_dir), DATE_AS_OF).select(*NEW_ACTIVITY.names)


@query
def sitemap_tree(spark, sf_dir):
    """Sitemaps that list sitemaps, two levels deep, of which one leads back to the root and one deeper still."""
    roots = views.order_sites(spark, sf_dir).select(page_source.sitemap_url(F.col("url")).alias("root"))
    return discovery.sitemap_pages(views.sitemap_trees(spark, sf_dir), roots, levels=2)


def _three_loads(spark, sf_dir, path: str) -> None:
    """Orders before 1994, all before 1997, and all: what was offered before comes again."""
    for name, until in (("first", "1994-01-01"), ("second", "1997-01-01"), ("third", "9999-01-01")):
        offered = views.activities(spark, sf_dir, views.orders_of_days(spark, sf_dir, until))
        store.append(path, offered.withColumnRenamed("id", "row_id"), name, order=["row_id"])


@query
def pinned_version(spark, sf_dir):
    """Three loads and a merge of all folders later, the version of the second load still reads the same."""
    path = scratch(spark)
    _three_loads(spark, sf_dir, path)
    store.compact(spark, path, keep=0)
    return store.read_store(spark, path, version=3).select(*_STORED)


@query
def compacted_store(spark, sf_dir):
    """All rows of three loads after their folders were merged into one."""
    path = scratch(spark)
    _three_loads(spark, sf_dir, path)
    store.compact(spark, path, keep=0)
    return store.read_store(spark, path).select(*_STORED)


@query
def status_of_loads(spark, sf_dir):
    """The counts of the whole store from those kept with each of three loads; no stored row is read."""
    path = scratch(spark)
    _three_loads(spark, sf_dir, path)
    return rollups.counts_of_cells(store.cells(spark, path))


@query
def store_is_empty(spark, sf_dir):
    """Whether a store is empty: before any load, after a load without rows, after a load of all listings."""
    path = scratch(spark)
    offered = views.activities(spark, sf_dir).withColumnRenamed("id", "row_id")
    store.init_store(spark, path)
    seen = [("created", store.is_empty(spark, path))]
    for name, rows in (("no rows", offered.filter("category IS NULL")), ("all rows", offered)):
        store.append(path, rows, name, order=["row_id"])
        seen.append((name, store.is_empty(spark, path)))
    return spark.createDataFrame(seen, "after string, is_empty boolean")


@query
def ranked_page(spark, sf_dir):
    """A page far down, from rows kept in reading order with the rank of each file."""
    path = scratch(spark)
    ranks.rank_rows(views.activities(spark, sf_dir).select("id", "title", "event_date", "event_time"), path, files=64)
    return ranks.ranked_page(spark, path, page=101, per_page=100)


@query
def load_counts(spark, sf_dir):
    """The report of a load: agenda pages that failed or have no HTML, sites with more pages than are read, and
    a store in which the events of every other site lie already."""
    path = scratch(spark)
    entry, agenda = views.entry_pages(spark, sf_dir), views.agenda_pages(spark, sf_dir)
    key = F.col("page_id")
    agenda = agenda.withColumn("html", F.when(key % 11 != 0, F.col("html"))).withColumn("status", F.when(key % 13 == 0, 404).otherwise(200))
    pages = agenda.union(entry.withColumn("status", F.lit(200)))
    sites, sitemaps = views.order_sites(spark, sf_dir), views.sitemaps(spark, sf_dir)
    load_activities(pages.filter((key < 0) | (key % 2 == 0)), sites, path, "first", DATE_AS_OF)
    return report.load_with_report(pages, sites, path, "second", DATE_AS_OF, sitemaps, max_pages=2)


@query
def site_registry(spark, sf_dir):
    """Every configured site, with the orders that fall to it when they are dealt over all sites in turn."""
    sites = registry.sites(spark)
    place = (F.col("category_ord") * len(registry.CITIES) + F.col("city_ord")).cast("long")
    dealt = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % sites.count()).alias("place")).agg(F.count("*").alias("orders"))
    return sites.withColumn("place", place).join(dealt, "place", "left").select(*sites.columns, "orders")


# ---------------------------------------------------------------- display


@query
def display_cards(spark, sf_dir):
    return display.with_card_columns(views.activities(spark, sf_dir)).select(
        "id", "category_label", "price_text", "is_free", "date_text", "age_text"
    )


@query
def has_more(spark, sf_dir):
    per_city = views.activities(spark, sf_dir).groupBy("city").agg(
        F.count("*").alias("total"), (F.countDistinct("category") * 10).cast("int").alias("page")
    )
    total, page, per_page = F.col("total"), F.col("page"), F.lit(20)
    shown = display.shown_so_far(total, page, per_page)
    return per_city.select(
        "city", "total", "page",
        shown.alias("shown"),
        display.has_more(total, page, per_page).alias("has_more"),
        display.counter_text(shown, total).alias("counter"),
    )
