import pytest
from pyspark.sql import functions as F

from affiche.functions import in_sql
from affiche.sources import pages as page_source

from .conftest import AS_OF

TEXTS = [
    None,
    "",
    "  ",
    "Spectacle de Noël : le 15 mars 2026 à 14h30, dès 6 ans, 12,50 €",
    "L’atelier – de 5 à 8 ans, entrée libre, 3/1/2024",
    "it's a \\d back\\slash and a 'quoted' \"word\"\n2025-02-30",
    "Conseil municipal 2019",
    "https://www.ville.example:8080/agenda/fête;x=1?q=1#top",
    "HTTP://A.example/sitemap.XML",
    "#ancre",
    "javascript:void(0)",
    "Tout l'agenda",
    "CONCERT GRATUIT " * 3_000,
]


@pytest.fixture(scope="module")
def registered(spark):
    return in_sql.register(spark, AS_OF)


@pytest.mark.parametrize("name", list(in_sql.rules(AS_OF)))
def test_a_function_gives_what_the_column_function_gives(spark, registered, name):
    parameters, rule = in_sql.rules(AS_OF)[name]
    others = TEXTS if len(parameters) == 2 else [None]
    rows = spark.createDataFrame([(a, b) for a in TEXTS for b in others], "a string, b string")
    args = ["a", "b"][: len(parameters)]
    both = rows.select("a", "b", rule(*map(F.col, args)).alias("column"), F.expr(f"{name}({', '.join(args)})").alias("sql"))
    assert both.filter("NOT (column <=> sql)").count() == 0
    assert both.filter("sql IS NOT NULL").count() > 0


def test_functions_can_be_registered_again_for_another_day(spark, registered):
    past = "SELECT is_past('fête', '2026-02-10') AS past"
    assert not spark.sql(past).first()["past"]
    in_sql.register(spark, AS_OF.replace(year=2027))
    assert spark.sql(past).first()["past"]
    in_sql.register(spark, AS_OF)


def test_rules_stay_off_python(spark, registered, plan_of):
    items = spark.range(3).selectExpr("cast(id as string) AS title")
    plan = plan_of(spark.sql("SELECT * FROM {items} WHERE is_family(matching_form(title))", items=items))
    assert "Python" not in plan and "Arrow" not in plan


def test_links_of_pages_with_repeated_ids_without_html_and_broken(spark, registered):
    rows = [
        (1, "https://s.fr/", '<nav><a href="/agenda">Agenda</a></nav><a href="#x">x</a>'),
        (1, "https://s.fr/", '<a href="b/c">C</a>'),
        (2, None, '<a href="http://[">bad</a>'),
        (None, "https://s.fr/", None),
        (3, "https://s.fr/", ""),
        (4, "https://s.fr/", "<a href='/x'" * 1_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    by_sql = spark.sql("SELECT page_id, url, l.* FROM {pages}, LATERAL page_links(url, html) AS l", pages=pages)
    by_frame = page_source.page_links(pages)
    assert by_sql.columns == by_frame.columns
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_frame.collect()))
    assert by_sql.filter("page_id = 1").count() == 3


def test_links_of_an_empty_table(spark, registered):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert spark.sql("SELECT * FROM {pages}, LATERAL page_links(url, html)", pages=pages).count() == 0
