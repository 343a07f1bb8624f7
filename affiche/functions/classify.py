"""Which items are one-off family events. Column predicates, null text counts as ''."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.matching import any_of, contains_any, starts_with_any
from affiche.functions.text import any_true, as_day, nfc, strip

# Digits besides the decimal ones, i.e. superscript, subscript and circled.
_DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
)


def title_text(title: Column) -> Column:
    """The title as the rules below see it: NFC, stripped."""
    return strip(nfc(F.coalesce(title, F.lit(""))))


def title_rejections(stripped: Column, normal: Column) -> dict[str, Column]:
    """Reasons to reject a title, by name. ``normal`` is the matching form of ``stripped``."""
    letters = F.regexp_count(stripped, F.lit(r"\p{L}"))
    capitals = F.regexp_count(stripped, F.lit(r"\p{Lu}"))
    return {
        "too_short": F.length(stripped) < lexicon.MIN_TITLE_CHARS,
        "url_start": normal.rlike(r"^(?:https?://|www\.)"),
        "url_inside": normal.rlike(r"www\.|https?://"),
        "domain": normal.rlike(rf"(?U)\w\.(?:{'|'.join(lexicon.DOMAIN_ENDINGS)})\b"),
        "path": stripped.contains(".")
        & stripped.contains("/")
        & ~F.substring(stripped, 1, 30).contains(" "),
        "email": stripped.contains("@") & stripped.contains("."),
        "file_end": any_true([normal.endswith(e) for e in lexicon.FILE_ENDINGS]),
        "file_inside": normal.contains(".pdf") | normal.contains(".doc"),
        "digits": F.regexp_count(stripped, F.lit(_DIGIT)) > F.length(stripped) * 0.5,
        "generic": normal.isin(lexicon.GENERIC_TITLES),
        "capitals": (F.length(stripped) < 40)
        & F.coalesce(F.try_divide(capitals, letters) > 0.85, F.lit(False)),
        "label": stripped.endswith(":") | stripped.endswith("："),
        "fragment": starts_with_any(normal, lexicon.FRAGMENT_STARTS),
        "nav_label": normal.isin(lexicon.NAV_LABELS),
    }


def looks_like_event_title(stripped: Column, normal: Column) -> Column:
    return ~any_true(list(title_rejections(stripped, normal).values()))


def is_institutional(normal: Column) -> Column:
    return contains_any(normal, lexicon.INSTITUTIONAL)


def is_punctual(normal: Column) -> Column:
    return contains_any(normal, lexicon.PUNCTUAL)


def is_family(normal: Column) -> Column:
    return contains_any(normal, lexicon.FAMILY)


def is_past(normal_title: Column, event_date: Column, as_of: dt.date) -> Column:
    """Dated over 30 days before ``as_of``, or a year 2000..last year anywhere in the title."""
    cutoff = F.lit(as_of - dt.timedelta(days=lexicon.PAST_GRACE_DAYS))
    past = F.coalesce(as_day(event_date) < cutoff, F.lit(False))
    years = [str(year) for year in range(lexicon.FIRST_PAST_YEAR, as_of.year)]
    return past | normal_title.rlike(any_of(years)) if years else past

