"""French text to values: normal form, date, time, price, age range.

All functions take and return Columns and stay on the JVM. Digits are matched as
0-9. White space is any Unicode white space: U+00A0 is the usual character before
a euro sign, and Java's plain ``\\s`` does not cover it. Searches that need a rare
character are led by a ``contains``, a byte search that costs next to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.matching import contains_any

_S = r"[\s\x1c-\x1f]"  # with (?U): every character Python's and Unicode's white space share


def strip(text: Column) -> Column:
    """Cut white space of any kind off both ends."""
    return F.btrim(text, F.lit(lexicon.SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def nfc(text: Column) -> Column:
    """Unicode NFC by the normaliser that ships with Spark; texts already in that form pass at once.

    ``reflect`` counts as non-deterministic for Catalyst: use the result in a
    select or withColumn, not inside an aggregate.
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.isNotNull(), composed)


def matching_form(text: Column) -> Column:
    """NFC, lower case, straight quotes and hyphens; null becomes ''.

    Six byte searches take half the time of one ``translate``, which builds every character anew.
    """
    form = F.lower(nfc(text))
    for mark, plain in zip(lexicon.QUOTES_AND_DASHES, lexicon.PLAIN_QUOTES_AND_DASHES):
        form = F.replace(form, F.lit(mark), F.lit(plain))
    return F.coalesce(form, F.lit(""))


def dedup_title(title: Column) -> Column:
    return strip(F.lower(title))


def summary_cut(text: Column) -> Column:
    return F.substring(text, 1, lexicon.MAX_SUMMARY_CHARS)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first hit of a pattern, null when there is none.

    Built on the list of hits: an empty-string test around ``regexp_extract`` would
    put the search into the generated code twice, and once more per level of nesting.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(0))


# ---------------------------------------------------------------- date


def _slash_date(text: Column) -> Column:
    found = first_match(text, "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}")
    padded = F.regexp_replace(found, "([0-9]+)/([0-9]+)/([0-9]+)", "$3-0$2-0$1")
    return F.regexp_replace(padded, "-0([0-9]{2})", "-$1")


def _worded_date(text: Column) -> Column:
    """Day, month word, year. The month list decides between several dates, not the text order.

    One pass with a look-ahead gathers every candidate, overlapping ones too
    ("15 mai 2026 mars 2027" holds two); it steps over the day, so "5 mai" of "15 mai" is none. The
    choice is then one ordered pattern on that short list: the first arm that fits leaves the only
    non-empty group, and a list of one needs no arm for its month.
    """
    months = "|".join(lexicon.MONTHS)
    every = rf"(?U)(?=([0-9]{{1,2}}{_S}+(?:{months})\.?{_S}+[0-9]{{4}}))[0-9]{{1,2}}"
    candidates = F.array_join(F.regexp_extract_all(text, F.lit(every), 1), "|")
    arms = "|".join(rf".*?([0-9]{{1,2}}{_S}+{word}\.?{_S}+[0-9]{{4}})" for word in lexicon.MONTHS)
    groups = "".join(f"${n}" for n in range(1, len(lexicon.MONTHS) + 2))
    chosen = F.regexp_replace(candidates, f"(?Us)^(?=.)(?:([^|]+)$|(?:{arms}).*$)", groups)
    date = F.regexp_replace(chosen, r"(?U)([0-9]+)[^\p{L}]+(\p{L}+)[^0-9]+([0-9]+)", "$3-$2-0$1")
    for word, number in lexicon.MONTHS.items():
        date = F.replace(date, F.lit(f"-{word}-"), F.lit(f"-{number}-"))
    return first_match(F.regexp_replace(date, "-0([0-9]{2})$", "-$1"), "^.+$")


def french_date(text: Column) -> Column:
    """First d/m/yyyy, else a worded date, else the first yyyy-mm-dd; the calendar is not checked."""
    lower = F.lower(text)
    return F.coalesce(
        F.when(text.contains("/"), _slash_date(text)),
        _worded_date(lower),
        F.when(text.contains("-"), first_match(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    )


def as_day(event_date: Column) -> Column:
    """The date of a yyyy-mm-dd text, null for any other text and for impossible days.

    Names its input once: a filter on the result is pushed below the parsing of the
    date and would repeat that for every mention.
    """
    return first_match(event_date, "^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$").try_cast("date")


# ---------------------------------------------------------------- time


def clock_time(text: Column) -> Column:
    """First 14h30 / 14H30 / 14:30, else the first 15h at the end of a word."""
    full = first_match(text, "[0-9]{1,2}[hH:][0-9]{2}")
    hour = first_match(text, r"(?U)([0-9]{1,2})[hH](?!\w)", 1)
    return F.coalesce(
        F.lpad(F.regexp_replace(full, "[hH]", ":"), 5, "0"),
        F.concat(F.lpad(hour, 2, "0"), F.lit(":00")),
    )


# ---------------------------------------------------------------- price

_AMOUNT = r"[0-9]++(?:[.,][0-9]{1,2})?"
_EURO = rf"{_S}*(?:€|eur(?:os?)?(?!\w))"


def _priced(text: Column, pattern: str, shown: str) -> Column:
    """Rewrite the first hit of the pattern; decimal commas become dots."""
    pattern = "(?U)" + pattern
    return F.replace(
        F.regexp_replace(first_match(text, pattern), pattern, shown), F.lit(","), F.lit(".")
    )


def price_label(normal_text: Column) -> Column:
    """Price of a text already in matching form: free, range, from, simple, euro sign first."""
    amount = rf"(?<![0-9])({_AMOUNT})"
    onward = rf"(?:[àa]{_S}+partir{_S}+de|d[èe]s){_S}+({_AMOUNT}){_EURO}"
    paid = F.coalesce(
        _priced(normal_text, rf"{amount}{_S}*(?:à|a|et|-){_S}*({_AMOUNT}){_EURO}", "$1€ - $2€"),
        _priced(normal_text, onward, "À partir de $1€"),
        _priced(normal_text, amount + _EURO, "$1€"),
        _priced(normal_text, rf"€{_S}*({_AMOUNT})", "$1€"),
    )
    return F.when(contains_any(normal_text, lexicon.FREE), F.lit(lexicon.PRICE_FREE)).when(
        normal_text.contains("€") | normal_text.contains("eur"), paid
    )


# ---------------------------------------------------------------- age


def _age_digits(text: Column) -> Column:
    lower = F.lower(text)
    between = rf"(?U)([0-9]{{1,2}}){_S}*[-àa]{_S}*([0-9]{{1,2}}){_S}*ans"
    onward = rf"(?U)d[eè]s{_S}+([0-9]{{1,2}}){_S}*ans"
    found = F.coalesce(
        F.regexp_replace(first_match(lower, between), between, "$1 $2"),
        F.regexp_replace(first_match(lower, onward), onward, f"$1 {lexicon.OPEN_AGE_MAX}"),
    )
    default = F.lit(f"{lexicon.DEFAULT_AGE_MIN} {lexicon.DEFAULT_AGE_MAX}")
    return F.split(F.coalesce(F.when(lower.contains("ans"), found), default), " ")


def age_bounds(text: Column) -> Column:
    """array(age_min, age_max) of "6-10 ans", "5 à 8 ans", "dès 6 ans"; 5-10 otherwise.

    A projection with a ``transform`` is never one whole-stage method. With a cast of the array, one of all the rules has
    more than 8,000 bytes, and HotSpot does not compile it unless the session sets ``hugeMethodLimit``.
    """
    return F.transform(_age_digits(text), lambda digits: digits.cast("int"))


def age_range(text: Column) -> Column:
    """``age_bounds`` as struct(age_min, age_max), without a lambda, which has no SQL form."""
    bounds = _age_digits(text).cast("array<int>")
    return F.struct(F.get(bounds, F.lit(0)).alias("age_min"), F.get(bounds, F.lit(1)).alias("age_max"))


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
