import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affiche.functions import lexicon, text

DATES = {
    "15 mars 2026": "2026-03-15",
    "1 janvier 2026": "2026-01-01",
    "samedi 20 avril 2026": "2026-04-20",
    "15/03/2026": "2026-03-15",
    "01/12/2026": "2026-12-01",
    "2026-04-15": "2026-04-15",
    "": None,
    "no date here": None,
    "99/99/2026": "2026-99-99",
    "1er mars 2026": None,
    "5 fevrier 2026": None,
    "20 avril 2026 puis 15 mars 2026": "2026-03-15",
    "15 mai 2026 mars 2027": "2027-03-26",
    "3 Août 2026": "2026-08-03",
    "7 déc. 2026": "2026-12-07",
    "le 2026-01-02 puis 5/6/2027": "2027-06-05",
    "12\n mars\t2026": "2026-03-12",
}
TIMES = {
    "14h30": "14:30", "9h00": "09:00", "à 15h": "15:00", "14:30": "14:30", "": None,
    "12h à 14h30": "14:30", "15 h": None, "24h/24": "24:00", "9Hé": None, "8H": "08:00",
}
PRICES = {
    "Gratuit": "Gratuit", "entrée libre": "Gratuit", "5€": "5€", "": None,
    "tarif: 12,50 €": "12.50€", "de 5 à 15 euros": "5€ - 15€", "dès 8€": "À partir de 8€",
    "€ 7": "7€", "14h30 - 5€": "30€ - 5€", "5 €": "5€", "3 euross": None, "3 eur.": "3€",
    "à partir de 4,5 euro": "À partir de 4.5€", "Entrée libre": "Gratuit", "1.234 €": "234€",
}
AGES = {
    "6-10 ans": (6, 10), "de 5 à 8 ans": (5, 8), "dès 6 ans": (6, 12), "": (5, 10),
    "dès 14 ans": (14, 12), "6–10 ans": (5, 10), "123-10 ans": (23, 10), "DES 4 ANS": (4, 12),
}


def price(t):
    return text.price_label(F.col("n"))


def test_dates(on_texts):
    assert on_texts(text.french_date, list(DATES)) == list(DATES.values())


def test_times(on_texts):
    assert on_texts(text.clock_time, list(TIMES)) == list(TIMES.values())


def test_prices(spark):
    rows = spark.createDataFrame([(k, v) for k, v in PRICES.items()], "t string, want string")
    got = rows.withColumn("n", text.matching_form(F.col("t"))).select("t", "want", price(None).alias("r"))
    assert {r["t"]: r["r"] for r in got.collect()} == PRICES


def test_ages(on_texts):
    assert [tuple(r) for r in on_texts(text.age_range, list(AGES))] == list(AGES.values())


def test_null_text(on_texts):
    assert on_texts(text.french_date, [None]) == [None]
    assert on_texts(text.clock_time, [None]) == [None]
    assert on_texts(text.matching_form, [None]) == [""]
    assert tuple(on_texts(text.age_range, [None])[0]) == (5, 10)


def test_matching_form(on_texts):
    assert on_texts(text.matching_form, ["L’Été – “A”", "Å"]) == ["l'été - \"a\"", "å"]


def test_strip_takes_all_white_space(on_texts):
    assert on_texts(text.strip, ["  \tx y 　\x1c"]) == ["x y"]


def test_summary_counts_code_points(on_texts):
    assert on_texts(text.summary_cut, ["é😀" * 200]) == ["é😀" * 150]


def test_lists_have_their_sizes():
    sizes = [
        (lexicon.MONTHS, 20), (lexicon.FAMILY, 50), (lexicon.INSTITUTIONAL, 117),
        (lexicon.GENERIC_TITLES, 86), (lexicon.FRAGMENT_STARTS, 43), (lexicon.NAV_LABELS, 8),
        (lexicon.PUNCTUAL, 29), (lexicon.AGENDA_PATH, 24), (lexicon.AGENDA_LINK_TEXT, 21),
        (lexicon.FREE, 10), (lexicon.BLOCK_SELECTORS, 19),
    ]
    assert [len(words) for words, _ in sizes] == [n for _, n in sizes]


# ---- the same rules once more in plain Python, for generated texts


def plain_date(t):
    t = t.lower()
    hit = re.search(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", t)
    if hit:
        return f"{hit[3]}-{int(hit[2]):02d}-{int(hit[1]):02d}"
    for word, number in lexicon.MONTHS.items():
        hit = re.search(rf"([0-9]{{1,2}})\s+{word}\.?\s+([0-9]{{4}})", t)
        if hit:
            return f"{hit[2]}-{number}-{int(hit[1]):02d}"
    hit = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", t)
    return hit and hit[0]


def plain_time(t):
    hit = re.search(r"([0-9]{1,2})[hH:]([0-9]{2})", t) or re.search(r"([0-9]{1,2})[hH]\b()", t)
    return hit and f"{hit[1].zfill(2)}:{hit[2] or '00'}"


def plain_price(t):
    t = unicodedata.normalize("NFC", t).lower()
    for a, b in zip("’‘“”–—", "''\"\"--"):
        t = t.replace(a, b)
    if any(w in t for w in lexicon.FREE):
        return "Gratuit"
    n, unit = r"([0-9]+(?:[.,][0-9]{1,2})?)", r"\s*(?:€|eur\b|euros?\b)"
    for pattern, shape in [
        (rf"{n}\s*(?:à|a|et|-)\s*{n}{unit}", "{}€ - {}€"),
        (rf"(?:à\s+partir\s+de|a\s+partir\s+de|dès|des)\s+{n}{unit}", "À partir de {}€"),
        (n + unit, "{}€"),
        (r"€\s*" + n, "{}€"),
    ]:
        hit = re.search(pattern, t)
        if hit:
            return shape.format(*[g.replace(",", ".") for g in hit.groups()])
    return None


def plain_age(t):
    t = t.lower()
    hit = re.search(r"([0-9]{1,2})\s*[-àa]\s*([0-9]{1,2})\s*ans", t)
    if hit:
        return int(hit[1]), int(hit[2])
    hit = re.search(r"d[eè]s\s+([0-9]{1,2})\s*ans", t)
    return (int(hit[1]), 12) if hit else (5, 10)


BITS = st.sampled_from(
    ["1", "5", "12", "30", "2026", "199", "/", "-", "–", " ", " ", " ", "h", "H", ":", "€", "eur", "euros",
     "euro", "à", "a", "et", "de ", "des ", "dès ", "à partir de ", "ans", "ANS", "mars", "mai", "août", "déc", ".",
     ",", "décembre", "janv", "é", "_", "gratuit", "libre", "entrée ", "é", "x", "\n"]
)
TEXTS = st.lists(st.lists(BITS, max_size=14).map("".join), min_size=150, max_size=300)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_generated_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "ix int, t string")
    got = rows.withColumn("n", text.matching_form(F.col("t"))).select(
        "t",
        text.french_date(F.col("t")).alias("date"),
        text.clock_time(F.col("t")).alias("time"),
        text.price_label(F.col("n")).alias("price"),
        text.age_range(F.col("t")).alias("age"),
    )
    for r in got.collect():
        t = r["t"]
        assert (r["date"], r["time"], r["price"], tuple(r["age"])) == (
            plain_date(t), plain_time(t), plain_price(t), plain_age(t)
        ), repr(t)


@pytest.mark.parametrize("words", [lexicon.FAMILY, lexicon.INSTITUTIONAL, ["a", "ab", "s.i.j", "b(c"]])
def test_word_patterns_equal_substring_search(on_texts, words):
    from affiche.functions.matching import contains_any

    texts = [f"x{w}y" for w in words] + [w[:-1] for w in words] + [w[1:] for w in words] + ["", "zzz"]
    want = [any(w in t for w in words) for t in texts]
    assert on_texts(lambda c: contains_any(c, words), texts) == want


def test_worded_dates_that_overlap(on_texts):
    dates = {
        "115 mai 2026": "2026-05-15",
        "12 déc. 2026 puis 1 mai 2027 et 3 mai 2028": "2027-05-01",
        "11 déc. 2026 11 avr 2027": "2027-04-11",
        "15 mai 2026 mars 2027 janv 2028": "2027-03-26",
        "5 oct 2026|5 octobre 2025": "2025-10-05",
    }
    assert on_texts(text.french_date, list(dates)) == list(dates.values())


def test_both_forms_of_the_age_rule(spark):
    rows = spark.createDataFrame([(t,) for t in [*AGES, None, "99-0 ans"]], "t string")
    both = rows.select(text.age_bounds(F.col("t")).alias("a"), text.age_range(F.col("t")).alias("r"))
    assert all(tuple(r["a"]) == tuple(r["r"]) for r in both.collect())
