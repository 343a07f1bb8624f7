"""The checked queries once more, as SQL for DuckDB over the same tables.

Written from the rules, not from the Spark plans: words are found with
``contains``, patterns follow RE2, first-wins rules are ``row_number`` filters.
"""

from __future__ import annotations

from affiche.functions import lexicon
from affiche.functions.lexicon import SPACES
from affiche.sources.registry import CITIES, SITES
from verification.views import DATE_AS_OF, YEAR_AS_OF


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(text(i) for i in items) + ")"


def has_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def starts_any(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {text(w)})" for w in words) + ")"


def spaced(column: str) -> str:
    return f"translate({column}, {text(SPACES)}, {text(' ' * len(SPACES))})"


def stripped(column: str) -> str:
    return f"trim({column}, {text(SPACES)})"


def normal(column: str) -> str:
    return (
        f"translate(lower(nfc_normalize({column})), "
        f"{text(lexicon.QUOTES_AND_DASHES)}, {text(lexicon.PLAIN_QUOTES_AND_DASHES)})"
    )


def rx(column: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({column}, {text(pattern)}, {group}), '')"


def two(digits: str) -> str:
    return f"lpad({digits}, 2, '0')"


def date_of(flat: str) -> str:
    """``flat``: lower case, single spaces."""
    slash = "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    tries = [
        f"{rx(flat, slash, 3)} || '-' || {two(rx(flat, slash, 2))} || '-' || {two(rx(flat, slash, 1))}"
    ]
    for word, number in lexicon.MONTHS.items():
        worded = rf"([0-9]{{1,2}}) +{word}\.? +([0-9]{{4}})"
        tries.append(f"{rx(flat, worded, 2)} || '-{number}-' || {two(rx(flat, worded, 1))}")
    tries.append(rx(flat, "([0-9]{4}-[0-9]{2}-[0-9]{2})"))
    return "coalesce(" + ", ".join(tries) + ")"


def time_of(column: str) -> str:
    full, hour = "([0-9]{1,2})[hH:]([0-9]{2})", r"([0-9]{1,2})[hH](?:$|[^0-9A-Za-z_\x{AA}-\x{24F}])"
    return (
        f"coalesce({two(rx(column, full, 1))} || ':' || {rx(column, full, 2)}, "
        f"{two(rx(column, hour, 1))} || ':00')"
    )


def price_of(norm: str, flat: str) -> str:
    """``norm``: matching form, ``flat``: the same with single spaces."""
    amount = r"([0-9]+(?:[.,][0-9]{1,2})?)"
    euro = r" *(?:€|eur(?:os?)?(?:$|[^0-9a-z_\x{AA}-\x{24F}]))"
    span = rf"{amount} *(?:à|a|et|-) *{amount}{euro}"
    onward = rf"(?:à +partir +de|a +partir +de|dès|des) +{amount}{euro}"

    def dot(x: str) -> str:
        return f"replace({x}, ',', '.')"

    return f"""CASE WHEN {has_any(norm, lexicon.FREE)} THEN 'Gratuit' ELSE coalesce(
      {dot(rx(flat, span, 1))} || '€ - ' || {dot(rx(flat, span, 2))} || '€',
      'À partir de ' || {dot(rx(flat, onward, 1))} || '€',
      {dot(rx(flat, amount + euro, 1))} || '€',
      {dot(rx(flat, '€ *' + amount, 1))} || '€') END"""


def age_of(flat: str, which: int) -> str:
    between, onward = "([0-9]{1,2}) *[-àa] *([0-9]{1,2}) *ans", "d[eè]s +([0-9]{1,2}) *ans"
    if which == 1:
        return f"cast(coalesce({rx(flat, between, 1)}, {rx(flat, onward, 1)}, '5') AS INTEGER)"
    return (
        f"cast(coalesce({rx(flat, between, 2)}, CASE WHEN {rx(flat, onward, 1)} IS NOT NULL "
        "THEN '12' END, '10') AS INTEGER)"
    )


def title_rules(s: str, n: str) -> dict[str, str]:
    """``s``: NFC, stripped; ``n``: matching form of it."""
    letters = rf"length(regexp_replace({s}, '\P{{L}}', '', 'g'))"
    capitals = rf"length(regexp_replace({s}, '\P{{Lu}}', '', 'g'))"
    domain = r"[0-9a-z_\x{AA}-\x{24F}]\.(fr|com|org|net|eu)(?:$|[^0-9a-z_\x{AA}-\x{24F}])"
    ends = " OR ".join(f"suffix({n}, {text(e)})" for e in lexicon.FILE_ENDINGS)
    return {
        "too_short": f"length({s}) < 10",
        "url_start": starts_any(n, ["http://", "https://", "www."]),
        "url_inside": has_any(n, ["www.", "http://", "https://"]),
        "domain": f"regexp_matches({n}, {text(domain)})",
        "path": f"(contains({s}, '.') AND contains({s}, '/') AND NOT contains(substring({s}, 1, 30), ' '))",
        "email": f"(contains({s}, '@') AND contains({s}, '.'))",
        "file_end": f"({ends})",
        "file_inside": has_any(n, [".pdf", ".doc"]),
        "digits": rf"length(regexp_replace({s}, '\P{{Nd}}', '', 'g')) > length({s}) * 0.5",
        "generic": f"{n} IN {values(lexicon.GENERIC_TITLES)}",
        "capitals": f"(length({s}) < 40 AND {letters} > 0 AND {capitals}::DOUBLE / greatest({letters}, 1) > 0.85)",
        "label": f"(suffix({s}, ':') OR suffix({s}, '：'))",
        "fragment": starts_any(n, lexicon.FRAGMENT_STARTS),
        "nav_label": f"{n} IN {values(lexicon.NAV_LABELS)}",
    }


def past_of(norm_title: str, event_date: str | None, as_of) -> str:
    years = [str(y) for y in range(2000, as_of.year)]
    parts = [has_any(norm_title, years)] if years else []
    if event_date:
        parts.append(
            f"coalesce(try_cast({event_date} AS DATE) < DATE '{as_of}' - INTERVAL 30 DAY, false)"
        )
    return "(" + " OR ".join(parts) + ")" if parts else "false"


# ---------------------------------------------------------------- derived inputs


def pick(key: str, *arms: str) -> str:
    """Arms are SQL expressions."""
    whens = " ".join(f"WHEN {key} % {len(arms)} = {i} THEN {arm}" for i, arm in enumerate(arms))
    return f"CASE {whens} END"


_D = "o.o_orderdate"
_TITLES = [
    "'Spectacle ' || c.c_mktsegment || ' ' || c.c_name",
    "'Stage vacances ' || c.c_mktsegment || ' ' || c.c_name",
    "'Conseil municipal ' || c.c_mktsegment || ' ' || c.c_name",
    "'Festival en famille ' || c.c_mktsegment || ' ' || c.c_name",
    "'Yoga ' || c.c_mktsegment || ' ' || c.c_name",
    "'CONCERT ' || c.c_mktsegment",
    f"'Contes de Noe\u0308l ' || year({_D})",
    "'www.' || lower(c.c_mktsegment) || '.fr programme'",
    "'Carnaval : ' || c.c_mktsegment || ' :'",
    "'samedi ' || c.c_mktsegment || ' kermesse'",
    "'Fête d’hiver – ' || c.c_name",
    "'01 23 45 67 89 ' || (o.o_orderkey % 100)",
    "'  DANSE contemporaine\u00a0'",
]
_DATES = [
    f"'le ' || day({_D}) || '/' || month({_D}) || '/' || year({_D})",
    f"'samedi ' || day({_D}) || ' mars ' || year({_D})",
    f"strftime({_D}, '%Y-%m-%d')",
    "'date à venir'",
    f"day({_D}) || ' déc. ' || year({_D}) || ' puis ' || day({_D}) || ' avril ' || year({_D})",
    f"day({_D}) || '\u00a0Août ' || year({_D})",
    f"'1er mars ' || year({_D})",
]
_TIMES = ["14h30", "à 9h", "", "18:05", "15 h"]
_PRICES = [
    "entrée libre", "12,50 €", "de 5 à 15 euros", "à partir de 8€", "€ 7", "tarif inconnu",
    "14h30 - 5€", "5\u00a0€", "dès 8,50 eur", "accès libre", "3 euross",
]
_AGES = ["6-10 ans", "dès 6 ans", "de 5 à 8 ans", "pour les enfants", "dès 14 ans", "6–10 ans"]

LISTINGS = f"""
listings AS (
  SELECT o.o_orderkey AS row_id,
    {pick("o.o_orderkey", "'library'", "'mjc'", "'theatre'")} AS category,
    n.n_name AS city,
    'https://www.' || lower(replace(n.n_name, '_', '-')) || '.example/agenda' AS source_url,
    {pick("o.o_orderkey", *_TITLES)} AS title,
    {pick("o.o_orderkey", *_DATES)} AS date_text,
    {pick("o.o_orderkey", *map(text, _TIMES))} AS time_text,
    {pick("o.o_orderkey", *map(text, _PRICES))} AS price_text,
    {pick("o.o_orderkey", *map(text, _AGES))} AS age_text
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

FULL_TEXT = "concat_ws(' ', title, date_text, time_text, price_text, age_text)"

FLAT = f"""
flat AS (
  SELECT *, {spaced("lower(date_text)")} AS flat_date, {spaced(normal("price_text"))} AS flat_price,
    {normal("price_text")} AS norm_price, {spaced("lower(age_text)")} AS flat_age
  FROM listings)"""

ACTIVITIES = f"""
activities AS (
  SELECT row_id AS id, title, age_text AS summary, CAST(NULL AS VARCHAR) AS link, category,
    {age_of("flat_age", 1)} AS age_min, {age_of("flat_age", 2)} AS age_max,
    {date_of("flat_date")} AS event_date, {time_of("time_text")} AS event_time,
    {price_of("norm_price", "flat_price")} AS price, city, source_url
  FROM flat)"""

A = f"WITH {LISTINGS}, {FLAT}, {ACTIVITIES} "
READ = "id, title, summary, link, category, age_min, age_max, event_date, event_time, price, city, source_url"


def classified(source: str, as_of, keep: str = "") -> str:
    """CTEs that run the event rules over ``source`` (title, full_text, ...); the last is ``events``."""
    rejected = " OR ".join(title_rules("s_title", "n_strip").values())
    return f"""
prepared AS (
  SELECT *, {stripped("nfc_normalize(title)")} AS s_title, {normal("title")} AS n_title,
    {stripped(normal("title"))} AS n_strip, {normal("full_text")} AS n_text,
    {spaced("lower(full_text)")} AS flat_text, {spaced(normal("full_text"))} AS flat_norm
  FROM {source}),
events AS (
  SELECT * FROM (
    SELECT *, {date_of("flat_text")} AS event_date, {time_of("full_text")} AS event_time,
      {price_of("n_text", "flat_norm")} AS price,
      {age_of("flat_text", 1)} AS age_min, {age_of("flat_text", 2)} AS age_max
    FROM prepared
    WHERE NOT ({rejected})
      AND NOT ({has_any("n_title", lexicon.INSTITUTIONAL)} OR {has_any("n_text", lexicon.INSTITUTIONAL)})
      AND ({has_any("n_title", lexicon.PUNCTUAL)} OR {has_any("n_text", lexicon.PUNCTUAL)})
      AND ({has_any("n_title", lexicon.FAMILY)} OR {has_any("n_text", lexicon.FAMILY)})) q
  WHERE NOT {past_of("n_title", "event_date", as_of)})"""


_SHOW = "(o.o_orderkey * 5 + i)"
_DAY = "(CAST(o.o_orderdate AS DATE) + CAST(i AS INTEGER))"
_LEAD = pick(_SHOW, f"'Résumé ' || {_SHOW} || ' court'", f"{_SHOW} || ' et suite'", f"CAST({_SHOW} AS VARCHAR)",
             f"'Texte libre ' || {_SHOW} || ' sans fin'")
_TITLE = pick(
    _SHOW,
    f"'Spectacle' || {_SHOW} || 'en famille'",
    f"'Stage vacances numéro ' || ({_SHOW} % 40)",
    f"'Atelier annuel & yoga ' || {_SHOW}",
    f"'Conseil municipal ' || {_SHOW}",
    f"'Conte d''hiver ' || {_SHOW} || 'pour tous'",
    "'Les ateliers du mois de mai'",
)
_TITLE_TEXT = pick(
    _SHOW,
    f"'Spectacle ' || {_SHOW} || ' en famille'",
    f"'Stage vacances numéro ' || ({_SHOW} % 40)",
    f"'Atelier annuel & yoga ' || {_SHOW}",
    f"'Conseil municipal ' || {_SHOW}",
    f"'Conte d''hiver ' || {_SHOW} || ' pour tous'",
    "'Les ateliers du mois de mai'",
)
_WHEN = f"'le ' || day({_DAY}) || '/' || month({_DAY}) || '/' || year({_DAY}) || ' à 15h'"
_FEE = f"'tarif ' || ({_SHOW} % 50) || ' €'"

# The items of the agenda pages, known without any HTML: pages of two blocks or more.
ITEMS = f"""
items AS (
  SELECT o.o_orderkey AS page_id, 'https://s' || o.o_orderkey || '.example/agenda/' || o.o_orderkey AS url,
    CASE o.o_orderkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS way,
    CAST(i AS INTEGER) AS place,
    {_TITLE} AS title,
    {_TITLE_TEXT} || ' ' || {_LEAD} || ' ' || {_WHEN} || ' ' || {_FEE} AS full_text,
    'https://s' || o.o_orderkey || '.example/evenement/' || {_SHOW} || '?ligne=' || i AS link,
    CASE {_SHOW} % 4 WHEN 0 THEN 'Résumé ' || {_SHOW} || ' court' WHEN 2 THEN CAST({_SHOW} AS VARCHAR) END AS desc_text,
    CASE {_SHOW} % 4 WHEN 0 THEN 'Résumé ' || {_SHOW} || ' court'
      WHEN 1 THEN CASE WHEN length({_SHOW} || ' et suite') > 10 THEN {_SHOW} || ' et suite' ELSE {_WHEN} || {_FEE} END
      WHEN 3 THEN 'Texte libre ' || {_SHOW} || ' sans fin' || {_WHEN} || {_FEE} END AS para_text
  FROM orders o, unnest(range(1, o.o_orderkey % 6 + 1)) AS u(i)
  WHERE o.o_orderkey % 6 >= 2)"""

_KEY = "o.o_orderkey"
_BASE = "('https://s' || o.o_orderkey || '.example')"
# Agenda pages of the order sites, known without any HTML, by navigation or the site page itself.
DISCOVERED = f"""
discovered AS (
  SELECT {_KEY} AS row_id, {_BASE} || '/accueil' AS seed,
    CASE {_KEY} % 5 WHEN 3 THEN {_BASE} || '/tout' WHEN 4 THEN {_BASE} || '/accueil'
      ELSE {_BASE} || '/agenda/' || {_KEY} END AS page_url
  FROM orders o)"""

_HOST = "split_part(split_part(url, '://', 2), '/', 1)"
LINKS = f"""
anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'), 1) - 1 AS link_ix
  FROM pages),
links AS (
  SELECT page_id, url, CAST(link_ix AS INTEGER) AS link_ix,
    split_part(url, '://', 1) || '://' || {_HOST} || regexp_extract(a, '<a href="([^"]*)">', 1) AS link_url,
    lower({stripped("regexp_extract(a, '>([^<]*)<', 1)")}) AS text
  FROM anchors)"""


# ---------------------------------------------------------------- the queries

_RULES = title_rules("s", "n")
_CONFIGURED_CITIES = ", ".join(f"({text(c)})" for c in CITIES)
_CONFIGURED_CATEGORIES = ", ".join(f"({text(c)})" for c in SITES)
_FLAGS = ", ".join(f"CAST({rule} AS BOOLEAN) AS {name}" for name, rule in _RULES.items())


def first_rows(source: str, keys: str, order: str, columns: str, n: int = 1) -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {source}) q WHERE rn <= {n}"
    )


TEXTS = f"""
texts AS (
  SELECT 'documents' AS source, doc_id AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'listings', row_id, {FULL_TEXT} FROM listings)"""

_BEST_GROUPS = """
groups AS (
  SELECT l_orderkey, l_returnflag AS class_key, count(*) AS n, avg(CAST(l_extendedprice / 1000 AS INTEGER)) AS avg_chars,
    bool_or(l_linestatus = 'O') AS has_heading, bool_or(l_discount > 0.05) AS has_link,
    min(l_linenumber) AS first_ix
  FROM lineitem WHERE CAST(l_extendedprice / 1000 AS INTEGER) > 30 AND NOT l_tax > 0.07
  GROUP BY 1, 2 HAVING count(*) >= 2)
"""

ORACLES = {
    # reads
    "activities_page": A
    + f"SELECT {READ} FROM activities WHERE category = 'library' AND city = 'NATION_7' "
    "AND (event_date >= '1997-01-01' OR event_date IS NULL) AND (event_date <= '2000-12-31' OR event_date IS NULL) "
    "AND age_min <= 7 AND age_max >= 7 "
    "ORDER BY event_date NULLS FIRST, event_time NULLS FIRST, id LIMIT 20 OFFSET 20",
    "activities_total": A
    + "SELECT count(*) AS total FROM activities WHERE category = 'library' "
    "AND (event_date >= '1997-01-01' OR event_date IS NULL) AND age_min <= 7 AND age_max >= 7",
    "deep_page": A
    + f"SELECT {READ} FROM activities ORDER BY event_date NULLS FIRST, event_time NULLS FIRST, id LIMIT 100 OFFSET 10000",
    "rows_after": A
    + f"SELECT {READ} FROM activities WHERE event_date > '1996-05-01' OR (event_date = '1996-05-01' AND (event_time > '14:30' "
    "OR (event_time = '14:30' AND id > 1000))) ORDER BY event_date, event_time NULLS FIRST, id LIMIT 200",
    "filter_category": A + "SELECT id, category FROM activities WHERE category = 'mjc'",
    "filter_city": A + "SELECT id, city FROM activities WHERE city = 'NATION_3'",
    "filter_dates": A
    + "SELECT id, event_date FROM activities WHERE (event_date >= '1996-05-01' OR event_date IS NULL) "
    "AND (event_date <= '1999-03-31' OR event_date IS NULL)",
    "filter_age": A + "SELECT id, age_min, age_max FROM activities WHERE age_min <= 11 AND age_max >= 11",
    "read_view": A + f"SELECT {READ} FROM activities",
    # lists and counts
    "distinct_cities": A + "SELECT DISTINCT city FROM activities ORDER BY city",
    "distinct_categories": A + "SELECT DISTINCT category FROM activities ORDER BY category",
    "cities_union": A
    + f"SELECT city FROM activities UNION SELECT * FROM (VALUES {_CONFIGURED_CITIES}) v(city) ORDER BY city",
    "categories_union": A
    + f"SELECT category FROM activities UNION SELECT * FROM (VALUES {_CONFIGURED_CATEGORIES}) v(category) ORDER BY category",
    "count_by_category": A + "SELECT category, count(*) AS cnt FROM activities GROUP BY category",
    "count_by_city": A + "SELECT city, count(*) AS cnt FROM activities GROUP BY city",
    "status_counts": A
    + "SELECT 'total' AS scope, CAST(NULL AS VARCHAR) AS name, count(*) AS cnt FROM activities "
    "UNION ALL SELECT 'category', category, count(*) FROM activities GROUP BY category "
    "UNION ALL SELECT 'city', city, count(*) FROM activities GROUP BY city",
    # text
    "parse_date": f"WITH {LISTINGS}, {FLAT} SELECT row_id, {date_of('flat_date')} AS event_date FROM flat",
    "parse_time": f"WITH {LISTINGS} SELECT row_id, {time_of('time_text')} AS event_time FROM listings",
    "parse_price": f"WITH {LISTINGS}, {FLAT} SELECT row_id, {price_of('norm_price', 'flat_price')} AS price FROM flat",
    "parse_age": f"WITH {LISTINGS}, {FLAT} SELECT row_id, {age_of('flat_age', 1)} AS age_min, "
    f"{age_of('flat_age', 2)} AS age_max FROM flat",
    "parse_documents": f"""WITH t AS (SELECT doc_id, text, {normal("text")} AS n, {spaced("lower(text)")} AS f,
      {spaced(normal("text"))} AS fn FROM documents)
      SELECT doc_id, {date_of("f")} AS event_date, {time_of("text")} AS event_time, {price_of("n", "fn")} AS price,
      {age_of("f", 1)} AS age_min, {age_of("f", 2)} AS age_max FROM t""",
    "normalise": f"SELECT doc_id, {normal('text')} AS normal_text FROM documents",
    "normalise_titles": f"WITH {LISTINGS} SELECT row_id, {normal('title')} AS normal_title, "
    f"{stripped('lower(title)')} AS dedup_title FROM listings",
    "summary_cut": "SELECT doc_id, substring(text, 1, 300) AS summary FROM documents",
    "url_parts": f"""SELECT page_id, split_part(url, '://', 1) AS scheme, {_HOST} AS host,
      split_part(split_part(substring(url, length(split_part(url, '://', 1)) + 4 + length({_HOST})), '#', 1), '?', 1) AS path
      FROM pages""",
    # classifiers
    "title_rules": f"WITH {LISTINGS}, t AS (SELECT row_id, {stripped('nfc_normalize(title)')} AS s, "
    f"{stripped(normal('title'))} AS n FROM listings) SELECT row_id, {_FLAGS}, "
    f"CAST(NOT ({' OR '.join(_RULES.values())}) AS BOOLEAN) AS is_title FROM t",
    "title_rules_conversations": f"WITH t AS (SELECT conv_id, turn, {stripped('nfc_normalize(text)')} AS s, "
    f"{stripped(normal('text'))} AS n FROM conversations) SELECT conv_id, turn, {_FLAGS} FROM t",
    **{
        name: f"WITH {LISTINGS}, {TEXTS} SELECT source, id FROM "
        f"(SELECT source, id, {normal('text')} AS n FROM texts) q WHERE {has_any('n', words)}"
        for name, words in [
            ("excluded", lexicon.INSTITUTIONAL), ("punctual", lexicon.PUNCTUAL), ("family", lexicon.FAMILY)
        ]
    },
    "content_flags": f"WITH {LISTINGS}, t AS (SELECT row_id, {normal(FULL_TEXT)} AS n FROM listings) "
    f"SELECT row_id, {has_any('n', lexicon.INSTITUTIONAL)} AS excluded, {has_any('n', lexicon.PUNCTUAL)} AS punctual, "
    f"{has_any('n', lexicon.FAMILY)} AS family FROM t",
    "past": A
    + f"SELECT id, {past_of('n', 'event_date', DATE_AS_OF)} AS past_by_date, "
    f"{past_of('n', None, YEAR_AS_OF)} AS past_by_title FROM (SELECT *, {normal('title')} AS n FROM activities) q",
    "classify_pipeline": f"WITH {LISTINGS}, sources AS (SELECT *, {FULL_TEXT} AS full_text FROM listings), "
    + classified("sources", DATE_AS_OF)
    + f" SELECT row_id, {stripped('title')} AS title, category, city, source_url, event_date, event_time, price, "
    "age_min, age_max FROM events",
    # dedup and load
    "first_wins_dedup": f"WITH {LISTINGS} "
    + first_rows(
        f"(SELECT *, {stripped('lower(title)')} AS k FROM listings)", "k, city, category", "row_id", "row_id, title, city, category"
    ),
    "required_rows": "SELECT o_orderkey, o_orderstatus, c_mktsegment FROM orders "
    "LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_mktsegment IS NOT NULL",
    "insert_if_absent": A
    + """, stored AS (SELECT a.* FROM activities a JOIN orders o ON o.o_orderkey = a.id WHERE o.o_orderdate < TIMESTAMP '1998-01-01'),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, event_date, city, source_url ORDER BY id) AS rn
      FROM activities WHERE event_date IS NOT NULL) q WHERE rn = 1
      UNION ALL SELECT *, 1 AS rn FROM activities WHERE event_date IS NULL)
    SELECT id, title, event_date, city, source_url FROM firsts b WHERE NOT EXISTS (SELECT 1 FROM stored s
      WHERE s.title = b.title AND s.event_date = b.event_date AND s.city = b.city AND s.source_url = b.source_url)""",
    "insert_if_absent_null_safe": A
    + """, stored AS (SELECT a.* FROM activities a JOIN orders o ON o.o_orderkey = a.id WHERE o.o_orderdate < TIMESTAMP '1998-01-01'),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, event_date, city, source_url ORDER BY id) AS rn
      FROM activities) q WHERE rn = 1)
    SELECT id, title, event_date, city, source_url FROM firsts b WHERE NOT EXISTS (SELECT 1 FROM stored s
      WHERE s.title = b.title AND s.event_date IS NOT DISTINCT FROM b.event_date AND s.city = b.city
        AND s.source_url = b.source_url)""",
    # crawl
    "crawl_plan": f"WITH {LISTINGS}, sites AS (SELECT category, city, min(source_url) AS url FROM listings GROUP BY 1, 2), "
    "cities AS (SELECT n_name AS city, n_nationkey AS city_ord FROM nation) "
    "SELECT s.category, s.city, s.url, CASE s.category WHEN 'library' THEN 0 WHEN 'mjc' THEN 1 ELSE 2 END AS category_ord, "
    "city_ord FROM sites s JOIN cities c ON s.city = c.city",
    "page_links": f"WITH {LINKS} SELECT page_id, link_ix, link_url, text, 0 AS zone FROM links",
    "absolute_urls": f"SELECT page_id, split_part(url, '://', 1) || '://' || {_HOST} || '/agenda/' || page_id AS rooted, "
    f"regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') || 'suite.html?p=2' AS beside, "
    f"split_part(url, '://', 1) || '://' || 'autre.example/x' AS elsewhere FROM pages",
    "link_first_wins": f"WITH {LINKS} "
    + first_rows("links", "page_id, link_url", "link_ix", "page_id, link_ix, link_url, text"),
    "agenda_links": f"""WITH {LINKS}, {DISCOVERED}, hits AS (SELECT *, lower(split_part(substring(link_url,
        length(split_part(link_url, '://', 1)) + 4 + length(split_part(split_part(link_url, '://', 2), '/', 1))), '?', 1)) AS p
      FROM links)
      SELECT DISTINCT page_id, link_url FROM hits
      WHERE {has_any('p', lexicon.AGENDA_PATH)} OR {has_any('text', lexicon.AGENDA_LINK_TEXT)}
      UNION ALL SELECT -1 - row_id, page_url FROM discovered WHERE row_id % 5 <> 4""",
    "nav_zones": f"""SELECT -1 - {_KEY} AS page_id, {_BASE} || {pick(_KEY, f"'/agenda/' || {_KEY}", f"'/agenda/' || {_KEY}",
        f"'/agenda/' || {_KEY}", "'/tout'", "'/tout'")} AS link_url,
        {pick(_KEY, "'tout'", "'toutvoir'", "'agenda'", "'nos spectacles'", "'tout'")} AS text, 1 AS zone FROM orders o
      UNION ALL SELECT -1 - o_orderkey, 'https://autre.example/agenda', 'agenda', 2 FROM orders""",
    "page_cap": f"WITH {LISTINGS} "
    + first_rows(
        "(SELECT DISTINCT city, source_url || '/' || row_id AS page_url FROM listings)", "city", "page_url", "city, page_url", 50
    ),
    "fallback_pages": "SELECT url AS seed, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id "
    "AND l.quality = 1) THEN url || '/agenda' ELSE url END AS page_url FROM pages p",
    "discover_pages": f"WITH {DISCOVERED} SELECT seed, page_url FROM discovered",
    "sitemap_locs": f"""SELECT {_BASE} || '/sitemap.xml' AS url, CAST(ix AS INTEGER) AS loc_ix,
        CASE ix WHEN 0 THEN {_BASE} || '/pages.XML' WHEN 1 THEN {_BASE} || '/saison?a=1&b=2' ELSE {_BASE} || '/contact' END AS loc
      FROM orders o, unnest([0, 1, 2]) u(ix)
      UNION ALL SELECT {_BASE} || '/pages.XML', CAST(ix AS INTEGER), CASE ix WHEN 0 THEN {_BASE} ||
        CASE o_orderkey % 2 WHEN 0 THEN '/animations/' ELSE '/presse/' END || o_orderkey ELSE {_BASE} || '/agenda.xml' END
      FROM orders o, unnest([0, 1]) u(ix)""",
    "sitemap_pages": f"""SELECT {_BASE} || '/sitemap.xml' AS root, {_BASE} || '/saison?a=1&b=2' AS page_url FROM orders o
      UNION ALL SELECT {_BASE} || '/sitemap.xml', {_BASE} || '/animations/' || o_orderkey FROM orders o WHERE o_orderkey % 2 = 0""",
    "discover_with_sitemaps": f"""WITH {DISCOVERED} SELECT seed, page_url FROM discovered WHERE row_id % 5 <> 4
      UNION ALL SELECT {_BASE} || '/accueil', {_BASE} || '/saison?a=1&b=2' FROM orders o
      UNION ALL SELECT {_BASE} || '/accueil', {_BASE} || '/animations/' || o_orderkey FROM orders o WHERE o_orderkey % 2 = 0""",
    # blocks and items
    "class_groups": f"WITH {_BEST_GROUPS} SELECT l_orderkey, class_key, n, round(avg_chars, 6) AS avg_chars, has_heading, "
    "has_link, first_ix FROM groups",
    "class_group_best": f"WITH {_BEST_GROUPS}, scored AS (SELECT *, n * sqrt(avg_chars) * CASE WHEN has_heading THEN 2.0 ELSE 1.0 END "
    "* CASE WHEN has_link THEN 1.5 ELSE 1.0 END AS score FROM groups) "
    "SELECT l_orderkey, class_key, n, first_ix, round(score, 4) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_orderkey ORDER BY score DESC, first_ix, class_key) AS rn FROM scored) q WHERE rn = 1",
    "event_items": f"WITH {ITEMS} SELECT page_id, url, way, place, title, full_text, link, desc_text, para_text FROM items",
    "item_summary": f"WITH {ITEMS} SELECT page_id, place, coalesce(CASE WHEN desc_text <> title THEN desc_text END, para_text) "
    "AS summary FROM items",
    "found_per_site": f"WITH {LISTINGS} SELECT category, city, count(*) AS found FROM listings GROUP BY 1, 2",
    "build_activities": f"WITH {LISTINGS}, {DISCOVERED}, {ITEMS}, "
    + classified("items", DATE_AS_OF)
    + f""", found AS (SELECT e.*, l.category, l.city, CAST(e.page_id % 3 AS INTEGER) AS category_ord,
        CAST(regexp_extract(l.city, '[0-9]+') AS INTEGER) AS city_ord,
        coalesce(CASE WHEN e.desc_text <> e.title THEN e.desc_text END, e.para_text) AS summary
      FROM events e JOIN discovered d ON d.page_url = e.url JOIN listings l ON l.row_id = d.row_id)
      SELECT title, summary, link, category, age_min, age_max, event_date, event_time, price, city, url AS source_url FROM
      (SELECT *, row_number() OVER (PARTITION BY {stripped("lower(title)")}, city, category
        ORDER BY category_ord, city_ord, url, place) AS rn FROM found) q WHERE rn = 1""",
    # display
    "display_cards": A
    + f"""SELECT id, CASE category WHEN 'library' THEN 'Bibliothèque' WHEN 'mjc' THEN 'MJC' WHEN 'theatre' THEN 'Théâtre'
        ELSE category END AS category_label,
      CASE WHEN coalesce(price, '') = '' THEN 'Non renseigné' ELSE price END AS price_text,
      coalesce(lower(price) = 'gratuit', false) AS is_free,
      (CASE WHEN event_date IS NULL THEN '' ELSE
        [{", ".join(map(text, lexicon.WEEKDAYS))}][dayofweek(d) + 1] || ' ' || day(d) || ' ' ||
        [{", ".join(map(text, lexicon.MONTH_NAMES))}][month(d)] || ' ' || year(d) END)
        || (CASE WHEN event_time IS NULL THEN '' ELSE ' à ' || event_time END) AS date_text,
      age_min || '-' || age_max || ' ans' AS age_text
      FROM (SELECT *, try_cast(event_date AS DATE) AS d FROM activities) q""",
    "has_more": A
    + """SELECT city, total, page, CAST(least(page * 20, total) AS BIGINT) AS shown, least(page * 20, total) < total AS has_more,
      least(page * 20, total) || ' sur ' || total || ' activité' || CASE WHEN total > 1 THEN 's' ELSE '' END AS counter
      FROM (SELECT city, count(*) AS total, CAST(count(DISTINCT category) * 10 AS INTEGER) AS page FROM activities GROUP BY city) q""",
    "insert_into_store": A
    + """SELECT title, event_date, event_time, price, city, source_url, category, age_min, age_max FROM (
      SELECT *, row_number() OVER (PARTITION BY title, event_date, city, source_url
        ORDER BY id) AS rn
      FROM activities WHERE event_date IS NOT NULL
      UNION ALL SELECT *, 1 FROM activities WHERE event_date IS NULL) q WHERE rn = 1""",
    "insert_twice": A
    + """, aged AS (SELECT a.*, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 1 ELSE 2 END AS load
        FROM activities a JOIN orders ON o_orderkey = a.id)
      SELECT title, event_date, event_time, price, city, source_url, category, age_min, age_max FROM (
      SELECT *, row_number() OVER (PARTITION BY title, event_date, city, source_url ORDER BY load, id) AS rn
      FROM aged WHERE event_date IS NOT NULL
      UNION ALL SELECT *, 1 FROM aged WHERE event_date IS NULL
      UNION ALL SELECT *, 1 FROM aged WHERE event_date IS NULL AND load = 1) q WHERE rn = 1""",
}
# One load into an empty table stores what the build finds.
ORACLES["incremental_load"] = ORACLES["build_activities"]
# Sites whose agenda is the site page itself have their events in neither run.
ORACLES["incremental_late_page"] = ORACLES["build_activities"]


def json_fields(columns: str) -> str:
    """A JSON object of the columns, nulls left out, numbers bare; no value here needs escaping."""
    parts = []
    for name in columns.split(", "):
        value = f"CAST({name} AS VARCHAR)" if name in ("id", "age_min", "age_max") else f"'\"' || {name} || '\"'"
        parts.append(f"'\"{name}\":' || {value}")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_IN_ORDER = "event_date NULLS FIRST, event_time NULLS FIRST, id"
ORACLES["response_envelope"] = A + f"""
  SELECT '[' || coalesce(string_agg(j, ',' ORDER BY {_IN_ORDER}), '') || ']' AS activities,
    (SELECT count(*) FROM activities WHERE city = 'NATION_7') AS total, 3 AS page, 50 AS per_page
  FROM (SELECT *, {json_fields(READ)} AS j FROM activities WHERE city = 'NATION_7'
    ORDER BY {_IN_ORDER} LIMIT 50 OFFSET 100) q"""
ORACLES["status_report"] = A + """
  SELECT (SELECT count(*) FROM activities) AS total_activities,
    (SELECT '{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}' FROM
      (SELECT category, count(*) AS n FROM activities GROUP BY 1) a) AS by_category,
    (SELECT '{' || string_agg('"' || city || '":' || n, ',' ORDER BY city) || '}' FROM
      (SELECT city, count(*) AS n FROM activities GROUP BY 1) b) AS by_city"""
ORACLES["unreadable_pages"] = "SELECT page_id, url, 'no HTML' AS error FROM pages WHERE page_id % 10 = 3"
ORACLES["snapshot_status"] = """SELECT * FROM (SELECT page_id, url,
    CAST([200, 204, 299, 300, 304, 404, 500, 199, NULL][page_id % 9 + 1] AS INTEGER) AS status FROM pages) q
  WHERE status IS NULL OR status BETWEEN 200 AND 299"""
ORACLES["newest_snapshots"] = """SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM (
  SELECT page_id * 10 + k AS page_id, url, html, row_number() OVER (PARTITION BY url ORDER BY
    CASE WHEN (page_id + k) % 7 <> 0 THEN (page_id * 7 + k * 5) % 4 END DESC NULLS LAST, page_id * 10 + k DESC) AS place
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k) t WHERE (page_id + k) % 6 <> 0) q WHERE place = 1"""
# The newest good fetch of every page is the one that the plain build reads.
ORACLES["recrawled_activities"] = ORACLES["bucketed_activities"] = ORACLES["build_activities"]
ORACLES["sitemap_tree"] = f"""SELECT {_BASE} || '/sitemap.xml' AS root, {_BASE} || '/agenda/' || name || {_KEY} AS page_url
  FROM orders o, (SELECT unnest(['r&', 'a', 'b']) AS name) t"""


def loaded(last: int) -> str:
    """What is stored after the first ``last`` of three loads, each of which offers all earlier orders again."""
    return f"""{A}, aged AS (SELECT a.*, CASE WHEN o_orderdate < DATE '1994-01-01' THEN 1 WHEN o_orderdate < DATE '1997-01-01' THEN 2
        ELSE 3 END AS load FROM activities a JOIN orders ON o_orderkey = a.id),
      stored AS (SELECT * EXCLUDE (rn, again) FROM (
        SELECT *, row_number() OVER (PARTITION BY title, event_date, city, source_url ORDER BY load, id) AS rn, 0 AS again
        FROM aged WHERE event_date IS NOT NULL AND load <= {last}
        UNION ALL SELECT aged.*, 1, again FROM aged, (SELECT unnest(range(1, {last} + 1)) AS again) t
        WHERE event_date IS NULL AND load <= again) q WHERE rn = 1)"""


_STORED = "title, event_date, event_time, price, city, source_url, category, age_min, age_max"
ORACLES["pinned_version"] = f"{loaded(2)} SELECT {_STORED} FROM stored"
ORACLES["compacted_store"] = f"{loaded(3)} SELECT {_STORED} FROM stored"
ORACLES["status_of_loads"] = f"""{loaded(3)} SELECT 'total' AS scope, CAST(NULL AS VARCHAR) AS name, count(*) AS cnt FROM stored
  UNION ALL SELECT 'category', category, count(*) FROM stored GROUP BY category
  UNION ALL SELECT 'city', city, count(*) FROM stored GROUP BY city"""
ORACLES["store_is_empty"] = A + """SELECT 'created' AS after, true AS is_empty
  UNION ALL SELECT 'no rows', count(*) = 0 FROM activities WHERE category IS NULL
  UNION ALL SELECT 'all rows', count(*) = 0 FROM activities"""
_SITES = ", ".join(
    f"({text(category)}, {text(city)}, {text(url)}, {i}, {k})"
    for i, (category, by_city) in enumerate(SITES.items())
    for k, (city, url) in enumerate(by_city.items())
)
ORACLES["site_registry"] = f"""SELECT category, city, url, category_ord, city_ord, orders
  FROM (VALUES {_SITES}) s(category, city, url, category_ord, city_ord)
  LEFT JOIN (SELECT o_orderkey % {sum(map(len, SITES.values()))} AS place, count(*) AS orders FROM orders GROUP BY 1) d
    ON d.place = category_ord * {len(CITIES)} + city_ord"""
ORACLES["ranked_page"] = A + f"""SELECT id, title, event_date, event_time FROM activities ORDER BY {_IN_ORDER} LIMIT 100 OFFSET 10000"""
_UNIQUE = f"""(SELECT *, row_number() OVER (PARTITION BY {stripped("lower(title)")}, city, category
  ORDER BY category_ord, city_ord, url, place) AS rn FROM found"""
ORACLES["load_counts"] = f"WITH {LISTINGS}, {DISCOVERED}, {ITEMS}, " + classified("items", DATE_AS_OF) + f""",
  candidates AS (SELECT seed, page_url FROM ({ORACLES["discover_with_sitemaps"]}) w WHERE NOT ends_with(page_url, '/accueil')),
  counted AS (SELECT row_id, l.category, l.city, (SELECT count(*) FROM candidates c
      WHERE c.seed = 'https://s' || row_id || '.example/accueil') AS n,
    row_id % 5 <= 2 AND row_id % 11 <> 0 AND row_id % 13 <> 0 AS readable FROM listings l),
  found AS (SELECT e.*, l.category, l.city, CAST(e.page_id % 3 AS INTEGER) AS category_ord,
      CAST(regexp_extract(l.city, '[0-9]+') AS INTEGER) AS city_ord
    FROM events e JOIN discovered d ON d.page_url = e.url JOIN listings l ON l.row_id = d.row_id
    WHERE e.page_id % 11 <> 0 AND e.page_id % 13 <> 0),
  first_load AS (SELECT * FROM {_UNIQUE} WHERE page_id % 2 = 0) q WHERE rn = 1),
  kept AS (SELECT *, event_date IS NULL OR NOT EXISTS (SELECT 1 FROM first_load f WHERE f.title = q.title
    AND f.event_date = q.event_date AND f.city = q.city AND f.url = q.url) AS new FROM {_UNIQUE}) q WHERE rn = 1),
  per_site AS (SELECT category, city, count(*) AS sites, CAST(sum(least(n, 2)) AS BIGINT) AS pages,
    CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS cut, CAST(sum(least(n, 2) - CAST(readable AS INTEGER)) AS BIGINT) AS unreadable
    FROM counted GROUP BY 1, 2)
  SELECT p.*, coalesce(f.n, 0) AS found, coalesce(u.n, 0) AS "unique", coalesce(u.new, 0) AS stored FROM per_site p
  LEFT JOIN (SELECT category, city, count(*) AS n FROM found GROUP BY 1, 2) f USING (category, city)
  LEFT JOIN (SELECT category, city, count(*) AS n, count(*) FILTER (new) AS new FROM kept GROUP BY 1, 2) u USING (category, city)"""
ORACLES["classify_in_sql"] = ORACLES["classify_pipeline"]
ORACLES["links_in_sql"] = f"""WITH {LINKS}, cut AS (SELECT *, {_HOST.replace("url", "link_url")} AS link_host, {_HOST} AS page_host FROM links)
  SELECT page_id, link_ix, link_url, text, 0 AS zone, link_host, link_host = page_host AS same_site FROM cut"""
