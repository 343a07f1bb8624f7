"""Ranks of pages far down, and the report of a load."""

import datetime as dt

import pytest

from affiche.operators import paging, ranks
from affiche.plans.report import load_with_report
from affiche.sources import registry, store
from tests.test_store import in_order, table


def test_ranked_pages_are_the_pages_of_the_table(spark, tmp_path):
    frame, rows = table(spark)
    path = str(tmp_path / "ranked")
    ranks.rank_rows(frame, path, files=7)
    want = in_order(rows)
    assert ranks.ranked_total(spark, path) == 500
    for page in (1, 2, 13, 25, 26, 1000):
        got = ranks.ranked_page(spark, path, page)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want[20 * page - 20 : 20 * page]], page
        assert got.columns == frame.columns


def test_a_page_opens_two_files_at_most(spark, tmp_path):
    """At every depth, and where one date holds most rows."""
    frame = spark.range(3000).selectExpr("id", "IF(id % 10 > 0, '2026-05-01', NULL) AS event_date", "'10:00' AS event_time")
    path = str(tmp_path / "ranked")
    ranks.rank_rows(frame, path, files=16)
    files = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(files) >= 12
    for page in (1, 16, 75, 150):
        opened = ranks.ranked_page(spark, path, page)
        assert 1 <= len(opened.inputFiles()) <= 2
        assert [r["id"] for r in opened.collect()] == [r["id"] for r in paging.page_rows(frame, page).collect()]


def test_ranks_of_nothing(spark, tmp_path):
    frame, _ = table(spark)
    path = str(tmp_path / "ranked")
    ranks.rank_rows(frame.filter("false"), path)
    assert ranks.ranked_total(spark, path) == 0 and ranks.ranked_page(spark, path).count() == 0


EVENT = "<article class='event'><h2>Spectacle numéro {0}</h2><p>le 1{0}/5/2026 pour tous, en famille</p></article>"


@pytest.fixture
def crawl(spark):
    links = "".join(f"<a href='/agenda/{k}'>Agenda</a>" for k in range(4))
    rows = [
        (1, "https://a.fr/", f"<nav>{links}</nav>", 200),
        (2, "https://a.fr/agenda/0", EVENT.format(1) + EVENT.format(2), 200),
        (3, "https://a.fr/agenda/1", EVENT.format(2) + EVENT.format(3), None),
        (4, "https://a.fr/agenda/2", None, 200),
        (5, "https://a.fr/agenda/3", EVENT.format(8) + EVENT.format(9), 200),
        (6, "https://b.fr/", EVENT.format(4) + EVENT.format(5), 200),
        (7, "https://c.fr/", EVENT.format(6) + EVENT.format(7), 500),
    ]
    sites = [("mjc", "Ici", "https://a.fr/", 0, 0), ("mjc", "Ici", "https://b.fr/", 0, 0), ("mjc", "Là", "https://c.fr/", 0, 1), ("library", "Là", "https://a.fr/", 1, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int"), spark.createDataFrame(sites, registry.SITE_SCHEMA)


def test_report_of_a_load(spark, tmp_path, crawl):
    pages, sites = crawl
    path = str(tmp_path / "store")
    runs = [load_with_report(pages, sites, path, name, dt.date(2026, 3, 1), max_pages=3) for name in ("1", "2")]
    names = ["category", "city", "sites", "pages", "cut", "unreadable", "found", "unique", "stored"]
    assert runs[0].columns == names
    first, second = ({tuple(r)[:2]: tuple(r)[2:] for r in run.collect()} for run in runs)
    # Titles are unique in a city and category; in the store title, date, city and source are.
    assert first == {("mjc", "Ici"): (2, 4, 1, 1, 6, 5, 5), ("mjc", "Là"): (1, 1, 0, 1, 0, 0, 0), ("library", "Là"): (1, 3, 1, 1, 4, 3, 3)}
    assert {k: v[-1] for k, v in second.items()} == dict.fromkeys(first, 0)
    assert {k: v[:-1] for k, v in second.items()} == {k: v[:-1] for k, v in first.items()}
    assert store.read_store(spark, path).count() == 8


def test_report_without_pages_or_sites(spark, tmp_path, crawl):
    pages, sites = crawl
    none = load_with_report(pages.filter("false"), sites, str(tmp_path / "a"), "1", dt.date(2026, 3, 1))
    assert {tuple(r)[2:] for r in none.collect()} == {(2, 2, 0, 2, 0, 0, 0), (1, 1, 0, 1, 0, 0, 0)}
    assert load_with_report(pages, sites.filter("false"), str(tmp_path / "b"), "1", dt.date(2026, 3, 1)).count() == 0
