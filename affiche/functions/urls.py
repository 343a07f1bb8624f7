"""URL parts, absolute URLs and the tests that pick agenda links.

The parts are cut by the generic URI pattern instead of ``parse_url``, which
rejects the spaces, accents and pipes found in real links.
"""

from __future__ import annotations

import sys
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affiche.functions import lexicon
from affiche.functions.matching import contains_any
from affiche.functions.text import strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def clean_url(url: Column) -> Column:
    """Drop tabs and line breaks anywhere, blanks and control characters in front."""
    return F.regexp_replace(F.translate(url, "\t\r\n", ""), r"^[\x00-\x20]+", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 1))


def host(url: Column) -> Column:
    """Host with port and user part, as written; '' when there is none."""
    return F.substring(F.regexp_extract(url, _URI, 2), 3, 2**31 - 1)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _URI, 3), ";[^/]*$", "")


def is_followable(href: Column) -> Column:
    """Not empty, not an anchor, not a script call."""
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def is_sub_sitemap(url: Column) -> Column:
    return F.lower(url).endswith(".xml")


def path_matches_agenda(url: Column) -> Column:
    return contains_any(F.lower(path(url)), lexicon.AGENDA_PATH)


def text_matches_agenda(text: Column) -> Column:
    return contains_any(strip(F.lower(text)), lexicon.AGENDA_LINK_TEXT)


def on_same_site(link: Column, base: Column) -> Column:
    return (host(link) == host(base)) | (host(link) == "")


def absolute(base: str, href: str) -> str | None:
    """``href`` seen from the page ``base``; null where it is no URL at all."""
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """``absolute`` for columns. The page reader resolves its own links; this is for other tables."""
    return pd.Series(
        [None if h is None else absolute(b or "", h) for b, h in zip(base, href)], dtype=object
    )
