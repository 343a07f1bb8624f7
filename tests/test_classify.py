import datetime as dt

import pytest
from pyspark.sql import functions as F

from affiche.functions import classify, display, lexicon, matching, text
from affiche.plans.build import family_events

FIRST_REASON = {
    "Spectacle de contes": None,
    "  Court  ": "too_short",
    "http://exemple/page": "url_start",
    "voir www.exemple": "url_inside",
    "le site mairie.fr ici": "domain",
    "le site écolé.fr ici": "domain",
    "dossiers/2026/page.html": "path",
    "ecrire a x.y@z ici": "email",
    "programme_été.xlsx": "file_end",
    "le fichier .pdf joint": "file_inside",
    "01 23 45 67 89": "digits",
    "²²²²²²abc²²": "digits",
    "Danse contemporaine": "generic",
    "ARTS DE LA RUE": "capitals",
    "Les activités du mois :": "label",
    "Les activités du mois：": "label",
    "Samedi spectacle": "fragment",
    "Retrouvez le festival": "fragment",
    "Spectacles": "nav_label",
    "Danse contemp’jazz": "generic",
}


def judged(spark, titles):
    rows = spark.createDataFrame([(t,) for t in titles], "title string").withColumns(
        {"s": classify.title_text(F.col("title")), "n": text.strip(text.matching_form(F.col("title")))}
    )
    rules = classify.title_rejections(F.col("s"), F.col("n"))
    verdict = classify.looks_like_event_title(F.col("s"), F.col("n"))
    return {
        r["title"]: r
        for r in rows.select("title", verdict.alias("ok"), *[c.alias(n) for n, c in rules.items()]).collect()
    }


def test_each_title_rule(spark):
    rows = judged(spark, FIRST_REASON)
    for title, reason in FIRST_REASON.items():
        row = rows[title]
        assert row["ok"] == (reason is None), title
        if reason:
            assert row[reason], (title, reason)


def test_rule_borders(spark):
    rows = judged(spark, ["abcdefghij", "ABCDEFGHIJKLMNOPQrst", "ABCDEFGHIJKLMNOPQRst", "12345abcde", "123456abcd"])
    assert rows["abcdefghij"]["ok"]
    assert not rows["ABCDEFGHIJKLMNOPQrst"]["capitals"]  # 17 of 20 is not over 85 %
    assert rows["ABCDEFGHIJKLMNOPQRst"]["capitals"]
    assert not rows["12345abcde"]["digits"]
    assert rows["123456abcd"]["digits"]


def test_dash_in_the_lists_never_matches(spark):
    # the title's dashes are rewritten, those of the lists are not
    rows = judged(spark, ["Enfance – jeunesse", "– un titre assez long"])
    assert rows["Enfance – jeunesse"]["ok"] and rows["– un titre assez long"]["ok"]


@pytest.mark.parametrize(
    "rule, hits, misses",
    [
        (classify.is_institutional, ["Conseil Municipal", "sur instagram hier", "l’esprit tranquille"], ["", "concert"]),
        (classify.is_punctual, ["Grande FÊTE", "raconte", "noël"], ["", "yoga"]),
        (classify.is_family, ["À PARTIR DE 3 ans", "Pâques", "6–10 ans"], ["", "concert"]),
    ],
)
def test_word_rules(on_texts, spark, rule, hits, misses):
    rows = spark.createDataFrame([(t,) for t in hits + misses], "t string").withColumn(
        "n", text.matching_form(F.col("t"))
    )
    got = {r["t"]: r["r"] for r in rows.select("t", rule(F.col("n")).alias("r")).collect()}
    assert got == {**dict.fromkeys(hits, True), **dict.fromkeys(misses, False)}


def test_past(spark):
    as_of = dt.date(2026, 3, 31)
    cases = [
        ("gala", "2026-02-28", True), ("gala", "2026-03-01", False), ("gala 2020", None, True),
        ("gala 2026", None, False), ("rue 12020", None, True), ("gala", "2026-99-99", False),
        ("gala", None, False), ("gala 1999", None, False), ("gala", "0000-01-01", False),
        ("gala", "2020", False),
    ]
    rows = spark.createDataFrame(cases, "t string, d string, want boolean")
    got = rows.select("*", classify.is_past(F.col("t"), F.col("d"), as_of).alias("r")).collect()
    assert [(r["t"], r["d"], r["r"]) for r in got] == cases
    early = rows.select(classify.is_past(F.col("t"), F.lit(None).cast("string"), dt.date(2000, 5, 1)).alias("r"))
    assert not any(r["r"] for r in early.collect())


def test_family_events(spark):
    items = spark.createDataFrame(
        [
            (1, "Spectacle de Noël", "le 15 mars 2026 à 14h30, 5 €, dès 4 ans"),
            (2, "Spectacle de Noël", "inscription scolaire"),
            (3, "Cours de piano adultes", "tous les jours"),
            (4, "Concert de printemps", "au parc"),
            (5, "Grand atelier du soir", "stage vacances pour tous"),
            (6, "Festival des lumières", "le 3/1/2026"),
            (7, "Festival 2019 en famille", ""),
        ],
        "id int, title string, full_text string",
    )
    got = {r["id"]: r for r in family_events(items, dt.date(2026, 3, 1)).collect()}
    assert sorted(got) == [1, 5]
    first = got[1]
    assert (first["event_date"], first["event_time"], first["price"], first["age_min"], first["age_max"]) == (
        "2026-03-15", "14:30", "5€", 4, 12,
    )
    assert got[5]["event_date"] is None and (got[5]["age_min"], got[5]["age_max"]) == (5, 10)


def test_cards(spark):
    rows = spark.createDataFrame(
        [
            ("library", "Gratuit", "2026-04-15", "14:00", 5, 10),
            ("autre", "", None, "09:00", 3, 6),
            ("mjc", None, "2026-04-15", None, 3, 6),
            ("theatre", "5€", None, None, 3, 6),
            ("mjc", "5€", "2026-99-99", "10:00", 3, 6),
        ],
        "category string, price string, event_date string, event_time string, age_min int, age_max int",
    )
    got = [
        tuple(r)
        for r in display.with_card_columns(rows)
        .select("category_label", "price_text", "is_free", "date_text", "age_text")
        .collect()
    ]
    assert got == [
        ("Bibliothèque", "Gratuit", True, "mer. 15 avril 2026 à 14:00", "5-10 ans"),
        ("autre", "Non renseigné", False, " à 09:00", "3-6 ans"),
        ("MJC", "Non renseigné", False, "mer. 15 avril 2026", "3-6 ans"),
        ("Théâtre", "5€", False, "", "3-6 ans"),
        ("MJC", "5€", False, None, "3-6 ans"),
    ]


def test_counter(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (45, 1), (45, 3)], "total long, page int")
    total, page = F.col("total"), F.col("page")
    shown = display.shown_so_far(total, page, F.lit(20))
    got = rows.select(shown, display.has_more(total, page, F.lit(20)), display.counter_text(shown, total)).collect()
    assert [tuple(r) for r in got] == [
        (0, False, ""),
        (1, False, "1 sur 1 activité"),
        (20, True, "20 sur 45 activités"),
        (45, False, "45 sur 45 activités"),
    ]


def test_every_fragment_start_rejects(spark):
    titles = [start + " suite du titre" for start in lexicon.FRAGMENT_STARTS]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    hits = rows.where(matching.starts_with_any(F.col("title"), lexicon.FRAGMENT_STARTS)).collect()
    assert {r["title"] for r in hits} == set(titles)
    inside = spark.createDataFrame([("le " + t,) for t in titles], "title string")
    missed = inside.where(~matching.starts_with_any(F.col("title"), lexicon.FRAGMENT_STARTS)).collect()
    wanted = {t for t in ("le " + t for t in titles) if not any(t.startswith(s) for s in lexicon.FRAGMENT_STARTS)}
    assert {r["title"] for r in missed} == wanted
