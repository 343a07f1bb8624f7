import datetime as dt

import pytest
from pyspark.sql import functions as F

from affiche.functions import urls
from affiche.operators import blocks, discovery, links
from affiche.plans.build import build_activities, found_activities
from affiche.plans.crawl import crawl_plan
from affiche.sources import pages as page_source
from affiche.sources import registry

from .conftest import AS_OF


def page(*bodies, url="https://s.fr/agenda/"):
    return [(i, url, f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def event(title, extra="", tag='article class="event"'):
    return f"<{tag}><h2>{title}</h2><p>le 15 mars 2026, une sortie pour tous {extra}</p></{tag.split()[0]}>"


def items(spark, *bodies):
    got = blocks.event_items(pages_of(spark, page(*bodies))).orderBy("page_id", "item_ix").collect()
    return [(r["page_id"], r["title"]) for r in got], got


def test_known_selector_needs_two(spark):
    names, _ = items(spark, event("Un") + event("Deux"), event("Seul"))
    assert names == [(0, "Un"), (0, "Deux")]


def test_first_selector_in_the_list_wins(spark):
    film, row = 'div class="film"', 'div class="views-row"'
    body = "".join(event(f"F{i}", tag=film) for i in range(3)) + "".join(event(f"R{i}", tag=row) for i in range(2))
    assert items(spark, body)[0] == [(0, "R0"), (0, "R1")]


def test_shared_classes_by_score(spark):
    card = 'div class="x card"'
    side = "<aside><ul>" + "".join(f'<li class="menu">entrée numéro {i} du menu latéral</li>' for i in range(9)) + "</ul></aside>"
    plain = "".join(f'<div class="note">une note plus courte mais longue {i}</div>' for i in range(2))
    body = side + plain + event("A", tag=card) + event("B", tag='div class="card  x"') + event("C", tag=card)
    names, rows = items(spark, body)
    assert names == [(0, "A"), (0, "B"), (0, "C")]
    assert {r["way"] for r in rows} == {blocks.SHARED_CLASSES}


def test_equal_scores_take_the_first_group(spark):
    a, b = 'div class="a"', 'div class="b"'
    body = event("B1", tag=b) + event("A1", tag=a) + event("B2", tag=b) + event("A2", tag=a)
    assert items(spark, body)[0] == [(0, "B1"), (0, "B2")]


def test_bare_articles_then_cards(spark):
    assert items(spark, event("Un", tag="article") + event("Deux", tag="article"))[0] == [(0, "Un"), (0, "Deux")]
    card = 'span class="card"'
    assert items(spark, event("Un", tag=card) + event("Deux", tag=card))[0] == [(0, "Un"), (0, "Deux")]


def test_short_and_navigation_blocks_do_not_count(spark):
    short = '<article class="event"><h2>Titre</h2></article>' * 3
    nav = f"<nav>{event('N1')}{event('N2')}</nav>"
    far = "<footer>" + "<div>" * 5 + event("F1") + event("F2") + "</div>" * 5 + "</footer>"
    near = "<footer>" + "<div>" * 4 + event("G1") + event("G2") + "</div>" * 4 + "</footer>"
    assert items(spark, short, nav, far, near)[0] == [(2, "F1"), (2, "F2")]


def test_texts_links_and_summaries(spark):
    first = (
        '<article class="event"><h2>Le <b>grand</b> jour</h2><p class="Chapo">Le grandjour</p><p>court</p>'
        f'<p>{"long " * 100}</p><a name="x">ancre</a><a href="../voir?a=1&amp;b=2">voir</a></article>'
    )
    second = (
        '<article class="event"><a href="//x.fr/y">Titre du lien seul</a><div class="my-summary">un résumé</div>'
        "<script>var p = '<p>non</p>';</script><!-- non --><p>autre paragraphe</p></article>"
    )
    untitled = '<article class="event"><p>un bloc sans titre mais assez long</p></article>'
    _, rows = items(spark, first + second + untitled)
    shown = spark.createDataFrame(rows).select(
        "title", "link", "full_text", blocks.summary(*map(F.col, ("title", "desc_text", "para_text"))).alias("s")
    )
    a, b = shown.orderBy("title").collect()
    assert (a["title"], a["link"]) == ("Legrandjour", "https://s.fr/voir?a=1&b=2")
    assert a["full_text"].startswith("Le grand jour Le grandjour court long long")
    assert a["s"] == "Le grandjour"
    assert (b["title"], b["link"], b["s"]) == ("Titre du lien seul", "https://x.fr/y", "un résumé")
    assert "non" not in b["full_text"]


def test_summary_rules(spark):
    long = "x" * 400
    rows = spark.createDataFrame(
        [("t", "t", "un paragraphe"), ("t", "", "un paragraphe"), ("t", None, None), ("t", long, None), ("t", "d", "p")],
        "title string, d string, p string",
    )
    got = [r[0] for r in rows.select(blocks.summary(F.col("title"), F.col("d"), F.col("p"))).collect()]
    assert got == ["un paragraphe", "un paragraphe", None, "x" * 300, "d"]


def test_broken_pages(spark):
    bodies = ["", "<p><b>x<p>y", "<div class='a", "<<<>>> & &amp; <a href=>z</a>", "<table><tr><td>a<tr><td>b"]
    frame = pages_of(spark, page(*bodies) + [(99, "https://s.fr/", None)])
    # A page stored without its HTML is reported, broken HTML is read as far as it goes.
    assert [tuple(r) for r in page_source.unreadable(frame).collect()] == [(99, "https://s.fr/", "no HTML")]
    assert blocks.event_items(frame).count() == 0
    assert page_source.page_blocks(frame).count() == 6


@pytest.mark.parametrize("bit", ["<!", "<a ", "<a b='", '<a b="', "<p><b>", "<div class=x>", "<script>", "<!--", "</p>", "<a href=x>", "<b></i>"])
def test_hostile_pages_take_linear_time(bit):
    import time

    def seconds(n):
        start = time.perf_counter()
        page_source.markup.read_page("https://s.fr/", bit * n, page_source._RULES)
        return time.perf_counter() - start

    small, large = max(seconds(2_000), 0.002), seconds(20_000)
    assert large < 40 * small


def test_bad_page_is_reported_not_fatal(spark, monkeypatch):
    def failing(url, html, rules):
        raise ValueError("no")

    monkeypatch.setattr(page_source.markup, "read_page", failing)
    frame = pages_of(spark, page("<p>x</p>"))
    assert [r["error"] for r in page_source.unreadable(frame).collect()] == ["ValueError: no"]
    assert page_source.page_links(frame).count() == 0


def test_failed_fetches_are_left_out(spark):
    rows = spark.createDataFrame([(1, 200), (2, 404), (3, None), (4, 299), (5, 301)], "page_id long, status int")
    assert sorted(r["page_id"] for r in page_source.successful(rows).collect()) == [1, 3, 4]


def test_nav_links(spark):
    body = (
        '<a href="/programme">Hors menu</a><a href="/contact">Contact</a>'
        '<ul class="Top-MENU"><li><a href="/agenda"> L\'Agenda </a></li></ul>'
        '<nav><a href="/agenda">Nav</a><a href="#x">x</a><a href="JavaScript:1">j</a><a href="javascript:1">j</a>'
        '<a href=" ">vide</a><a href="https://autre.fr/agenda">Autre</a><a href="sortir">Que faire</a></nav>'
    )
    frame = pages_of(spark, page(body, url="https://s.fr/a/b"))
    got = links.nav_links(frame)
    texts = {r["link_url"]: (r["text"], r["zone"]) for r in got.collect()}
    assert texts == {
        "https://s.fr/agenda": ("nav", 0),
        "JavaScript:1": ("j", 0),
        "https://autre.fr/agenda": ("autre", 0),
        "https://s.fr/a/sortir": ("que faire", 0),
        "https://s.fr/programme": ("hors menu", 2),
    }
    agenda = {r["link_url"] for r in links.agenda_links(got).collect()}
    assert agenda == {"https://s.fr/agenda", "https://s.fr/a/sortir", "https://s.fr/programme"}


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("https://s.fr/a/b", "c", "https://s.fr/a/c"),
        ("https://s.fr/a/b", "../c?x=1#y", "https://s.fr/c?x=1#y"),
        ("https://s.fr/a/b", "//t.fr/c", "https://t.fr/c"),
        ("https://s.fr/a/b?q=1", "?q=2", "https://s.fr/a/b?q=2"),
        ("https://s.fr", "c", "https://s.fr/c"),
        ("https://s.fr/a", "mailto:x@y.fr", "mailto:x@y.fr"),
        ("https://s.fr/a", "/c d", "https://s.fr/c d"),
        ("https://s.fr/a", "/c/./d/../e", "https://s.fr/c/e"),
        ("https://s.fr/a", "http://[bad", None),
        (None, "/x", "/x"),
    ],
)
def test_absolute_url(spark, base, href, want):
    row = spark.createDataFrame([(base, href)], "b string, h string")
    assert row.select(urls.absolute_url("b", "h")).first()[0] == want
    read = page_source.page_links(pages_of(spark, [(1, base or "", f'<a href="{href}">x</a>')])).first()
    assert read["link_url"] == want


def test_url_tests(spark):
    cases = [
        ("https://s.fr/Mon-Agenda;x", True), ("https://agenda.fr/x", False), ("https://s.fr/x?y=agenda", False),
        ("https://s.fr/les é|vè/activités", True), ("/saison", True), ("https://s.fr/x/;agenda", False), (None, None),
    ]
    rows = spark.createDataFrame(cases, "u string, want boolean")
    got = rows.select("u", urls.path_matches_agenda(F.col("u")).alias("r")).collect()
    assert [(r["u"], r["r"]) for r in got] == cases
    same = spark.createDataFrame(
        [("https://s.fr/x", "http://s.fr/", True), ("/x", "https://s.fr", True), ("https://www.s.fr/x", "https://s.fr", False),
         ("https://s.fr:81/x", "https://s.fr/", False)], "a string, b string, want boolean",
    )
    assert all(r["want"] == r["r"] for r in same.select("want", urls.on_same_site(F.col("a"), F.col("b")).alias("r")).collect())


SITES = [("mjc", "Ici", "https://a.fr/", 1, 0), ("library", "Ici", "https://a.fr/", 0, 0), ("mjc", "Là", "https://b.fr/x", 1, 1)]


def test_discovery(spark):
    sites = spark.createDataFrame(SITES, registry.SITE_SCHEMA)
    home = '<nav><a href="/agenda">A</a><a href="https://b.fr/agenda">B</a></nav>'
    frame = pages_of(spark, [(1, "https://a.fr/", home), (2, "https://b.fr/x", "<p>rien</p>")])
    found = {tuple(r) for r in discovery.discover(sites, frame).collect()}
    assert found == {("https://a.fr/", "https://a.fr/agenda"), ("https://b.fr/x", "https://b.fr/x")}

    maps = spark.createDataFrame(
        [
            ("https://a.fr/sitemap.xml", "<loc>https://a.fr/Sub.XML</loc><loc>https://a.fr/contact</loc><loc> https://a.fr/news/agenda&amp;1 </loc>"),
            ("https://a.fr/Sub.XML", "<urlset><LOC>https://a.fr/saison</LOC><loc>https://a.fr/agenda.xml</loc><broken"),
            ("https://b.fr/sitemap.xml", "".join(f"<loc>https://b.fr/event/{i:03d}</loc>" for i in range(80))),
        ],
        page_source.SITEMAPS,
    )
    got = {}
    for r in discovery.discover(sites, frame, maps).collect():
        got.setdefault(r["seed"], set()).add(r["page_url"])
    assert got["https://a.fr/"] == {"https://a.fr/agenda", "https://a.fr/news/agenda&1", "https://a.fr/saison"}
    assert got["https://b.fr/x"] == {f"https://b.fr/event/{i:03d}" for i in range(50)}


def test_no_pages_no_sitemaps(spark):
    sites = spark.createDataFrame(SITES, registry.SITE_SCHEMA)
    found = discovery.discover(sites, pages_of(spark, []))
    assert {tuple(r) for r in found.collect()} == {("https://a.fr/", "https://a.fr/"), ("https://b.fr/x", "https://b.fr/x")}


def test_build(spark):
    sites = spark.createDataFrame(SITES, registry.SITE_SCHEMA)
    home = '<nav><a href="/agenda/1">A</a><a href="/agenda/2">B</a><a href="/agenda/3">C</a></nav>'
    one = event("Spectacle de magie", "5 €") + event("Spectacle de MAGIE ", "7 €") + event("Yoga du matin doux")
    two = event("spectacle de magie", "9 €") + event("Conte du soir bleu", "gratuit")
    frame = pages_of(
        spark,
        [(1, "https://a.fr/", home), (2, "https://a.fr/agenda/1", one), (3, "https://a.fr/agenda/2", two), (4, "https://b.fr/x", one)],
    )
    assert found_activities(frame, sites, AS_OF).count() == 2 * 4 + 2
    got = {(r["category"], r["city"], r["title"], r["price"]) for r in build_activities(frame, sites, AS_OF).collect()}
    assert got == {
        (category, city, title, price)
        for category, city in [("mjc", "Ici"), ("library", "Ici"), ("mjc", "Là")]
        for title, price in [("Spectacle de magie", "5€"), ("Conte du soir bleu", "Gratuit")]
        if (city, title) != ("Là", "Conte du soir bleu")
    }


def test_crawl_plan(spark):
    assert registry.sites(spark).count() == 33
    plan = crawl_plan(registry.categories(spark), registry.cities(spark), registry.sites(spark))
    assert plan.count() == 33
    partial = registry.sites(spark, {"mjc": {"Chatou": "u", "Ailleurs": "v"}, "cirque": {"Chatou": "w"}})
    assert [r["url"] for r in crawl_plan(registry.categories(spark), registry.cities(spark), partial).collect()] == ["u"]


def test_default_day_is_today(spark):
    year = dt.date.today().year
    frame = spark.createDataFrame([(f"Festival {year - 1} du lac", ""), (f"Festival {year} en famille", "")], "title string, full_text string")
    from affiche.plans.build import family_events

    assert [r["title"] for r in family_events(frame).collect()] == [f"Festival {year} en famille"]


def test_snapshots_that_share_an_id_stay_apart(spark):
    def page(word):
        return "".join(f"<article><h2>{word} numéro {n}</h2><p>{word} et encore un texte de {word}</p></article>" for n in (1, 2))

    rows = [(7, "https://a.fr/", page("ALPHA")), (7, "https://b.fr/", page("BETA"))]
    items = blocks.event_items(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["url"], r["title"]) for r in items) == [
        ("https://a.fr/", "ALPHA numéro 1"), ("https://a.fr/", "ALPHA numéro 2"),
        ("https://b.fr/", "BETA numéro 1"), ("https://b.fr/", "BETA numéro 2"),
    ]
    assert all(r["full_text"].startswith(r["title"]) for r in items)


_HREFS = (
    "/a a/b #h ?q=1 javascript:void(0) mailto:a@b https://x.fr https://x.fr/a/../b HTTP://x.fr/a http://x.fr/a? http://x.fr/a# //y/z "
    "./x/../agenda/5 ../up a//b a/./b a/.b é/ü a:b a;p http://[x http:/x https:x javascript://x /a//b /a;b a/ x/?a=1#f a? a# . .. %20x"
).split()


@pytest.mark.parametrize("base", ["https://s.fr", "https://s.fr/a/b", "https://s.fr/a//b", "https://s.fr/.a/b", "https://s.fr/a;p/b", "https://s.fr/a?q=/x#f", "HTTPS://S.fr/a", "a/b"])
def test_reader_of_links_reads_nothing_else(base):
    from affiche.functions.urls import absolute

    rules = {**page_source._RULES, "only_links": True}
    html = "<nav class=event>avant" + "".join(f'<a href="{href}">Lien <b>{n}</b></a> entre<p>un texte</p>' for n, href in enumerate(_HREFS))
    facts = page_source.markup.read_page(base, html, rules)
    assert [link[2] for link in facts.links] == [absolute(base, href) for href in _HREFS]
    assert [link[3] for link in facts.links] == [f"lien{n}" for n in range(len(_HREFS))]
    assert facts.pieces == [part for n in range(len(_HREFS)) for part in ("Lien", str(n))]
    assert facts.paras == facts.blocks == []


def test_reader_remembers_start_tags_for_one_set_of_rules():
    rules = {**page_source._RULES, "tags": {}}
    html = '<article class="event wide"><h3>Un</h3></article>'
    first, again = (page_source.markup.read_page("https://s.fr/", html, rules).blocks for _ in range(2))
    assert first == again == page_source.markup.read_page("https://s.fr/", html, page_source._RULES).blocks
    assert [tag.classes for tag in rules["tags"].values()] == [["event", "wide"], None]
    page_source.markup.read_page("https://s.fr/", "".join(f"<i id={n}>" for n in range(10_000)), rules)
    assert len(rules["tags"]) <= page_source.markup._REMEMBERED


def test_links_of_the_same_classes_share_a_tag(monkeypatch):
    made, tag = [], page_source.markup._Tag

    def counted(*args):
        made.append(args[0])
        return tag(*args)

    monkeypatch.setattr(page_source.markup, "_Tag", counted)
    html = "<nav>" + "".join(f'<a class="nav-link {n % 2}" href="/agenda/{n}">Lien {n}</a>' for n in range(100)) + "</nav>"
    for links in (True, False):
        made.clear()
        facts = page_source.markup.read_page("https://s.fr/", html, {**page_source._RULES, "only_links": links, "tags": {}})
        assert sorted(made) == ["a", "a", "nav"]
        assert [link[2] for link in facts.links] == [f"https://s.fr/agenda/{n}" for n in range(100)] * links


def test_facts_go_to_arrow_column_by_column(spark, monkeypatch):
    """Lists of a page without facts, null structs and empty lists keep their places."""
    schema = page_source.T.StructType.fromDDL(
        f"page_id bigint, url string, pieces array<string>, paras array<{page_source.PARA}>, blocks array<{page_source.BLOCK}>, error string"
    )
    read_page = page_source.markup.read_page

    def failing(url, html, rules):
        if html == "bad":
            raise ValueError("no")
        return read_page(url, html, rules)

    monkeypatch.setattr(page_source.markup, "read_page", failing)
    html = '<div class="card"><h3>Un &amp; deux</h3><p>texte</p></div><p class="film"></p>'
    columns = [[1, 2, 3, 4], ["https://s.fr/", None, "u", "v"], [html, None, "bad", ""]]
    batch = page_source.pa.RecordBatch.from_arrays([page_source.pa.array(c) for c in columns], names=["page_id", "url", "html"])
    (out,) = page_source._reader(schema, False)(iter([batch]))
    full, none, bad, empty = out.to_pylist()
    assert out.schema.equals(page_source.to_arrow_schema(schema))
    assert full["pieces"] == ["Un & deux", "texte"] and full["error"] is None
    assert full["paras"] == [{"start": 1, "stop": 2, "chars": 5}, {"start": 2, "stop": 2, "chars": 0}]
    assert [b["title"] for b in full["blocks"]] == [{"start": 0, "stop": 1}, None]
    assert [b["classes"] for b in full["blocks"]] == [["card"], ["film"]]
    assert [b["text"] for b in full["blocks"]] == [{"start": 0, "stop": 2}, {"start": 2, "stop": 2}]
    assert none == {"page_id": 2, "url": None, "pieces": [], "paras": [], "blocks": [], "error": "no HTML"}
    assert bad == {"page_id": 3, "url": "u", "pieces": None, "paras": None, "blocks": None, "error": "ValueError: no"}
    assert empty == {"page_id": 4, "url": "v", "pieces": [], "paras": [], "blocks": [], "error": None}
