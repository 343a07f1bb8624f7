"""The text, title and URL rules as SQL functions of a session.

``register(spark)`` makes them temporary functions, so that a job can be written in SQL alone:

    SELECT french_date(text) AS event_date FROM documents WHERE is_family(matching_form(text))

Each function's body is the SQL form that Spark gives of the column function of the same rule, so there is one
definition of every rule, and Catalyst sees the same expression as in a DataFrame job: no UDF, nothing leaves the JVM.
The page reader is the one exception, as it is in DataFrame jobs: ``LATERAL page_links(url, html)`` is an Arrow UDTF.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from affiche.functions import classify, text, urls
from affiche.sources import pages

Rule = Callable[..., Column]


def rules(as_of: dt.date) -> dict[str, tuple[list[str], Rule]]:
    """Name, parameters (all strings) and column function of each SQL function; ``as_of`` is what ``is_past`` goes by."""
    return {
        # text to values
        "strip_spaces": (["text"], text.strip),
        "matching_form": (["text"], text.matching_form),
        "dedup_title": (["title"], text.dedup_title),
        "summary_cut": (["text"], text.summary_cut),
        "french_date": (["text"], text.french_date),
        "clock_time": (["text"], text.clock_time),
        "price_label": (["normal_text"], text.price_label),
        "age_range": (["text"], text.age_range),
        # what an item is
        "title_text": (["title"], classify.title_text),
        "is_event_title": (["stripped", "normal"], classify.looks_like_event_title),
        "is_institutional": (["normal"], classify.is_institutional),
        "is_punctual": (["normal"], classify.is_punctual),
        "is_family": (["normal"], classify.is_family),
        "is_past": (["normal_title", "event_date"], lambda title, date: classify.is_past(title, date, as_of)),
        # links
        "url_scheme": (["url"], urls.scheme),
        "url_host": (["url"], urls.host),
        "url_path": (["url"], urls.path),
        "is_followable": (["href"], urls.is_followable),
        "is_sub_sitemap": (["url"], urls.is_sub_sitemap),
        "is_agenda_path": (["url"], urls.path_matches_agenda),
        "is_agenda_text": (["text"], urls.text_matches_agenda),
        "is_same_site": (["link", "base"], urls.on_same_site),
    }


def body(spark: SparkSession, parameters: list[str], rule: Rule) -> tuple[str, str]:
    """SQL form and SQL type of a rule over the given string parameters."""
    empty = spark.createDataFrame([], ", ".join(f"{name} string" for name in parameters))
    made = empty.select(rule(*[F.col(name) for name in parameters]).alias("made"))
    expression = made._jdf.queryExecution().analyzed().expressions().head().child()
    return expression.sql(), made.schema["made"].dataType.simpleString()


def register(spark: SparkSession, as_of: dt.date | None = None) -> list[str]:
    """Makes or replaces the functions in this session and returns their names.

    ``as_of`` is today if not given. Strings in the bodies are escaped, so ``spark.sql.parser.escapedStringLiterals``
    must be off, as it is by default. A null argument gives what the column function gives for null.
    """
    made = rules(as_of or dt.date.today())
    for name, (parameters, rule) in made.items():
        sql, returned = body(spark, parameters, rule)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} STRING' for p in parameters)}) "
            f"RETURNS {returned} RETURN {sql}"
        )
    spark.udtf.register("page_links", pages.links_function())
    return [*made, "page_links"]
