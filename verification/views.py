"""Inputs of the checked queries, derived from the given tables.

The tables hold no French event texts and no agenda pages, so both are made from
``orders``, ``customer`` and ``nation``, row by row and without grouping: every
order becomes a listing, and a site with an entry page, two sitemaps and an agenda
page of zero to five event blocks. ``verification.oracles`` derives the same in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affiche.functions.text import age_bounds, clock_time, french_date, matching_form, price_label

DATE_AS_OF = dt.date(1998, 6, 1)
WORKED_ON = ("orders", "documents", "conversations")
YEAR_AS_OF = dt.date(2026, 12, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Where much work follows per row, its rows are dealt to all cores: the files have one row group."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism) if name in WORKED_ON else rows


def pick(key: Column, *texts: Column | str) -> Column:
    """One of the texts by the key, so that every wording occurs all over the table."""
    choice = F.lit(None).cast("string")
    for place, text in reversed(list(enumerate(texts))):
        text = F.lit(text) if isinstance(text, str) else text
        choice = F.when(key % len(texts) == place, text).otherwise(choice)
    return choice


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def orders_of_days(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """The orders whose key has an order before a day: what a semi join of their listings by key would keep."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    early = orders.filter(F.col("o_orderdate") < F.lit(until)).select("o_orderkey")
    return orders.join(early, "o_orderkey", "left_semi").repartition(spark.sparkContext.defaultParallelism)


def listings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One listing per order: row_id, category, city, source_url, title and the text parts."""
    rows = (
        (table(spark, sf_dir, "orders") if orders is None else orders)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    return rows.select(
        key.alias("row_id"),
        pick(key, "library", "mjc", "theatre").alias("category"),
        F.col("n_name").alias("city"),
        joined(
            "https://www.", F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), ".example/agenda"
        ).alias("source_url"),
        pick(
            key,
            joined("Spectacle ", segment, " ", name),
            joined("Stage vacances ", segment, " ", name),
            joined("Conseil municipal ", segment, " ", name),
            joined("Festival en famille ", segment, " ", name),
            joined("Yoga ", segment, " ", name),
            joined("CONCERT ", segment),
            joined("Contes de Noe\u0308l ", y),
            joined("www.", F.lower(segment), ".fr programme"),
            joined("Carnaval : ", segment, " :"),
            joined("samedi ", segment, " kermesse"),
            joined("Fête d\u2019hiver \u2013 ", name),
            joined("01 23 45 67 89 ", key % 100),
            "  DANSE contemporaine\u00a0",
        ).alias("title"),
        pick(
            key,
            joined("le ", d, "/", m, "/", y),
            joined("samedi ", d, " mars ", y),
            F.date_format(day, "yyyy-MM-dd"),
            "date à venir",
            joined(d, " déc. ", y, " puis ", d, " avril ", y),
            joined(d, "\u00a0Août ", y),
            joined("1er mars ", y),
        ).alias("date_text"),
        pick(key, "14h30", "à 9h", "", "18:05", "15 h").alias("time_text"),
        pick(
            key,
            "entrée libre",
            "12,50 €",
            "de 5 à 15 euros",
            "à partir de 8€",
            "€ 7",
            "tarif inconnu",
            "14h30 - 5€",
            "5\u00a0€",
            "dès 8,50 eur",
            "accès libre",
            "3 euross",
        ).alias("price_text"),
        pick(
            key, "6-10 ans", "dès 6 ans", "de 5 à 8 ans", "pour les enfants", "dès 14 ans", "6\u201310 ans"
        ).alias("age_text"),
    )


def full_text() -> Column:
    return F.concat_ws(" ", "title", "date_text", "time_text", "price_text", "age_text")


def activities(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The listings as an activity table, parsed from their text parts."""
    ages = age_bounds(F.col("age_text"))
    return (
        listings(spark, sf_dir, orders)
        .withColumn("normal_price", matching_form(F.col("price_text")))
        .select(
            F.col("row_id").alias("id"),
            "title",
            F.col("age_text").alias("summary"),
            F.lit(None).cast("string").alias("link"),
            "category",
            F.get(ages, F.lit(0)).alias("age_min"),
            F.get(ages, F.lit(1)).alias("age_max"),
            french_date(F.col("date_text")).alias("event_date"),
            clock_time(F.col("time_text")).alias("event_time"),
            price_label(F.col("normal_price")).alias("price"),
            "city",
            "source_url",
        )
    )


# ---------------------------------------------------------------- sites and their pages


def site_of(key: Column) -> Column:
    return joined("https://s", key, ".example/accueil")


def agenda_of(key: Column) -> Column:
    return joined("https://s", key, ".example/agenda/", key)


def order_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per order, in the city of its customer."""
    key = F.col("row_id")
    return listings(spark, sf_dir).select(
        "category",
        "city",
        site_of(key).alias("url"),
        (key % 3).cast("int").alias("category_ord"),
        F.regexp_extract("city", "[0-9]+", 0).cast("int").alias("city_ord"),
    )


def agenda_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agenda page of each order, one way of marking up events after the other."""
    order = F.col("o_orderkey")
    opening = pick(
        order,
        '<article class="event">',
        '<div class="card wide">',
        "<article>",
        '<section class="wide  card">',
    )
    closing = pick(order, "</article>", "</div>", "</article>", "</section>")

    def block(place: Column) -> Column:
        show = order * 5 + place
        day = F.date_add("o_orderdate", place)
        title = pick(
            show,
            joined("Spectacle <b>", show, "</b> en famille"),
            joined("Stage vacances num\u00e9ro ", show % 40),
            joined("Atelier annuel &amp; yoga ", show),
            joined("Conseil municipal ", show),
            joined("Conte d&#39;hiver ", show, " <!-- new --> pour tous"),
            "Les ateliers du mois de mai",
        )
        lead = pick(show, '<p class="chapo">Résumé ', "<p>", '<div class="summary">', "<p>Texte libre ")
        end = pick(show, " court</p>", " et suite<p>", "</div>", " sans fin ")
        return joined(
            opening, "<h3>", title, "</h3>", lead, show, end,
            "<span>le ", F.dayofmonth(day), "/", F.month(day), "/", F.year(day), " à 15h</span>",
            ' <a href="/evenement/', show, "?ligne=", place, '">tarif ', show % 50, " €</a>", closing,
        )

    places = F.when(order % 6 > 0, F.sequence(F.lit(1), (order % 6).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    html = joined(
        "<html><head><title>Agenda</title><script>var a = '<p>';</script></head><body>",
        '<nav><ul><li class="card">Accueil du site, rubriques et informations pratiques</li></ul></nav>',
        F.array_join(F.transform(places, block), "\n"),
        "</body></html>",
    )
    return table(spark, sf_dir, "orders").select(
        order.alias("page_id"), agenda_of(order).alias("url"), html.alias("html")
    )


def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry page of each site: a way to its agenda page on most, among other links."""
    order = F.col("o_orderkey")
    link = pick(
        order,
        joined('<a href="/agenda/', order, '">Tout</a>'),
        joined('<a href=" agenda/', order, ' ">Tout <b>voir</b></a>'),
        joined('<a href="./x/../agenda/', order, '">Agenda</a>'),
        '<a href="/tout">Nos spectacles</a>',
        '<a href="/tout">Tout</a>',
    )
    html = joined(
        '<body><header><a href="#haut">haut</a><a href="javascript:void(0)">menu</a></header>',
        '<div class="main-menu"><ul><li>', link, "</ul></div>",
        '<a href="https://autre.example/agenda">Agenda</a>',
        '<p><a href="/contact">Programme</a><a href="/tout">Agenda</a></body>',
    )
    return table(spark, sf_dir, "orders").select(
        (-1 - order).alias("page_id"), site_of(order).alias("url"), html.alias("html")
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a root sitemap with two pages and a further sitemap that names two more."""
    order = F.col("o_orderkey")
    base = joined("https://s", order, ".example")
    root = joined(
        "<sitemapindex><sitemap><loc> ", base, "/pages.XML </loc></sitemap>",
        "<url><loc>", base, "/saison?a=1&amp;b=2</loc></url>",
        "<url><loc>", base, "/contact</loc></url>",
    )
    child = joined(
        "<urlset><url><loc>", base, pick(order, "/animations/", "/presse/"), order, "</loc></url>",
        "<url><loc>", base, "/agenda.xml</loc></url></urlset>",
    )
    both = F.array(
        F.struct(joined(base, "/sitemap.xml").alias("url"), root.alias("xml")),
        F.struct(joined(base, "/pages.XML").alias("url"), child.alias("xml")),
    )
    return table(spark, sf_dir, "orders").select(F.inline(both))


def sitemap_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order four sitemaps: the root lists a, a lists b, b lists the root again and c. Each names an agenda page."""
    order = F.col("o_orderkey")
    base = joined("https://s", order, ".example")

    def sitemap(name: str, page: str, *listed: str) -> Column:
        sitemaps = [joined("<sitemap><loc>", base, f"/{x}.xml</loc></sitemap>") for x in listed]
        xml = joined("<urlset><url><loc>", base, page, order, "</loc></url>", *sitemaps, "</urlset>")
        return F.struct(joined(base, f"/{name}.xml").alias("url"), xml.alias("xml"))

    all_four = F.array(
        sitemap("sitemap", "/agenda&#x2F;r&#38;", "a", "a"),
        sitemap("a", "/agenda/a", "b", "sitemap"),
        sitemap("b", "/agenda/b", "sitemap", "c", "a"),
        sitemap("c", "/agenda/c"),
    )
    return table(spark, sf_dir, "orders").select(F.inline(all_four))
