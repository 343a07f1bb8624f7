"""The configured cities and the venue site of each category and city."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SITE_SCHEMA = "category string, city string, url string, category_ord int, city_ord int"

# --- fixed values: cities in crawl order -----------------------------------------
CITIES = [
    "Le Vésinet",
    "Le Pecq",
    "Chatou",
    "Croissy-sur-Seine",
    "Montesson",
    "Saint-Germain-en-Laye",
    "Rueil-Malmaison",
    "Nanterre",
    "Bougival",
    "Marly-le-Roi",
    "La Celle-Saint-Cloud",
]

# --- fixed values: venue sites, categories in crawl order --------------------------
SITES = {
    "library": {
        "Le Vésinet": "https://www.boucledesmediatheques.fr/opac/cms/articleviewrecent/nb/50",
        "Le Pecq": "https://lepecq-pom.c3rb.org/index.php/agenda/bibliotheques-municipales",
        "Chatou": "https://mediatheque.chatou.fr/",
        "Croissy-sur-Seine": "https://bibliotheque.croissy.com/",
        "Montesson": "https://www.boucledesmediatheques.fr/mediatheque-de-montesson",
        "Saint-Germain-en-Laye": "https://mediatheques.saintgermainenlaye.fr/",
        "Rueil-Malmaison": "https://mediatheques.mairie-rueilmalmaison.fr/",
        "Nanterre": "https://mediatheques.nanterre.fr/",
        "Bougival": "https://www.bougival.fr/bibliotheque/",
        "Marly-le-Roi": "https://marlyleroi.fr/mediatheque-pierre-bourdan/",
        "La Celle-Saint-Cloud": "https://lacellesaintcloud.fr/culture/bibliotheque/",
    },
    "mjc": {
        "Le Vésinet": "https://www.mjclevesinet.fr/activites",
        "Le Pecq": "https://mptccam.goasso.org/activites",
        "Chatou": "https://mjcchatou.org/",
        "Croissy-sur-Seine": "https://jeunessecroissy.fr/",
        "Montesson": "https://www.mjcmontesson.com/",
        "Saint-Germain-en-Laye": "https://laclef.aniapp.fr/activites",
        "Rueil-Malmaison": "https://www.mjc-rueil.asso.fr/",
        "Nanterre": "https://www.maisons-pour-tous-nanterre.fr/",
        "Bougival": "https://www.ville-bougival.fr/vie-associative/associations-culturelles/",
        "Marly-le-Roi": "https://mjcmarly.asso.fr/",
        "La Celle-Saint-Cloud": "https://lacellesaintcloud.fr/jeunesse/la-kab-mjc/",
    },
    "theatre": {
        "Le Vésinet": "https://www.vesinet.org/programmation/",
        "Le Pecq": "https://www.ville-lepecq.fr/lequai3",
        "Chatou": "https://www.chatou.fr/mon-quotidien/culture/centre-culturel-et-de-loisirs",
        "Croissy-sur-Seine": "https://www.croissy.com/agenda",
        "Montesson": "https://www.montesson.fr/agenda/",
        "Saint-Germain-en-Laye": "https://tad.saintgermainenlaye.fr/1845/saison",
        "Rueil-Malmaison": "https://www.tam.fr",
        "Nanterre": "https://www.nanterre-amandiers.com/",
        "Bougival": "https://www.ville-bougival.fr/bouger-sortir/culture/theatre-du-grenier/",
        "Marly-le-Roi": "https://www.ccjeanvilar.fr/",
        "La Celle-Saint-Cloud": "https://www.culture-lacellesaintcloud.fr/",
    },
}


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(CITIES, range(len(CITIES)))), "city string, city_ord int")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(SITES, range(len(SITES)))), "category string, category_ord int")


def sites(spark: SparkSession, registry: dict[str, dict[str, str]] = SITES) -> DataFrame:
    """The registry as a table. A new category is a new entry, no code."""
    rows = [
        (category, city, url, category_ord, CITIES.index(city) if city in CITIES else len(CITIES) + place)
        for category_ord, (category, by_city) in enumerate(registry.items())
        for place, (city, url) in enumerate(by_city.items())
    ]
    # An Arrow table becomes a relation of known size, so joins with page snapshots are planned as broadcasts.
    names = ["category", "city", "url", "category_ord", "city_ord"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    columns = zip(*rows) if rows else [[]] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), SITE_SCHEMA)
