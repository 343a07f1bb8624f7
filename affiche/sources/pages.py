"""Page snapshots, what is read off them, and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affiche.functions import lexicon, markup
from affiche.functions.text import strip
from affiche.functions.urls import host, scheme
from affiche.sources.settle import written

# Executors get the small page reader with the job: no package to install there.
cloudpickle.register_pickle_by_value(markup)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("html", T.StringType()),
    ]
)
# A snapshot as stored by a crawl, with the HTTP status and the time of its fetch.
SNAPSHOT = T.StructType(
    [*PAGES.fields, T.StructField("status", T.IntegerType()), T.StructField("fetched_at", T.TimestampType())]
)
SITEMAPS = "url string, xml string"

_RANGE = "struct<start:int,stop:int>"
PARA = "struct<start:int,stop:int,chars:int>"
LINK = "struct<link_ix:int,href:string,link_url:string,text:string,zone:int>"
BLOCK = (
    "struct<ix:int,tag:string,classes:array<string>,chars:int,in_nav:boolean,"
    "has_heading:boolean,has_link:boolean,link:string,"
    f"text:{_RANGE},title:{_RANGE},summary:{_RANGE},paras:{_RANGE}>"
)

_RULES = {
    "zone_tags": frozenset(lexicon.LINK_ZONE_TAGS),
    "zone_classed_tags": frozenset(lexicon.LINK_ZONE_CLASSED_TAGS),
    "zone_parts": tuple(lexicon.LINK_ZONE_CLASS_PARTS),
    "nav_tags": frozenset(lexicon.NAV_ANCESTOR_TAGS),
    "nav_classes": frozenset(lexicon.NAV_ANCESTOR_CLASSES),
    "nav_levels": lexicon.NAV_ANCESTOR_LEVELS,
    "title_tags": frozenset(lexicon.TITLE_TAGS),
    "heading_tags": frozenset(lexicon.HEADING_TAGS),
    "summary_tags": frozenset(lexicon.SUMMARY_TAGS),
    "summary_parts": tuple(lexicon.SUMMARY_CLASS_PARTS),
    "plain_blocks": frozenset(s for s in lexicon.FALLBACK_SELECTORS if "." not in s),
    "classed_blocks": frozenset(lexicon.GROUPED_TAGS),
    "block_classes": frozenset(
        s.split(".")[1] for s in lexicon.BLOCK_SELECTORS + lexicon.FALLBACK_SELECTORS if "." in s
    ),
}


def read_pages(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """Stored snapshots with a declared schema; failed fetches are left out if a status is kept."""
    return successful(spark.read.schema(SNAPSHOT).format(fmt).load(location)).drop("status", "fetched_at")


def read_newest(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """The same, of each URL the snapshot that was fetched last."""
    stored = spark.read.schema(SNAPSHOT).format(fmt).load(location)
    return newest(successful(stored)).select(*PAGES.names)


def successful(pages: DataFrame) -> DataFrame:
    """Only 2xx snapshots; rows without a status count as fetched."""
    if "status" not in pages.columns:
        return pages
    return pages.filter(F.col("status").isNull() | F.col("status").between(200, 299))


def newest(pages: DataFrame) -> DataFrame:
    """Of each URL the snapshot fetched last; of equal times the one with the largest page_id.

    A snapshot without a time is older than any other, one without a URL is left out, and a table without the column
    ``fetched_at`` stays as it is. Rows that repeat URL, time and page_id are one fetch and stay together. Only these
    three columns are aggregated, in each task first, and written; HTML meets the winners by URL, as a broadcast
    where Spark finds them small, without a shuffle where it lies in buckets of the URL (``snapshots``).
    """
    if "fetched_at" not in pages.columns:
        return pages
    fetch = F.struct("fetched_at", "page_id")
    last = written(pages.filter("url IS NOT NULL").groupBy(F.col("url").alias("__url")).agg(F.max(fetch).alias("__last")))
    # Joined by URL alone: time and number are compared on the pair, so buckets of the URL are enough.
    return pages.join(last, (pages["url"] == F.col("__url")) & (fetch >= F.col("__last")), "left_semi")


def page_links(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """(page_id, url, link_ix, href, link_url, text, zone): every ``<a href>`` of every page, in page order.

    Pages are read where they are scanned. ``partitions`` deals them anew first, for a few large files.
    """
    facts = _read(pages.repartition(partitions) if partitions else pages, links=True)
    return facts.select("page_id", "url", F.inline("links"))


def links_function():
    """``page_links(url, html)`` for SQL: the links of one page as a table, to be used with LATERAL.

    A page without HTML, and one that the reader gives up on, has no links.
    """
    rules, read_page = {**_RULES, "only_links": True}, markup.read_page

    class PageLinks:
        def eval(self, url: str, html: str):
            try:
                links = read_page(url or "", html or "", rules).links
            except Exception:  # as in ``unreadable``, which names such pages
                links = []
            yield from links

    return F.udtf(PageLinks, returnType=LINK.removeprefix("struct<").removesuffix(">").replace(":", " "), useArrow=True)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, pieces, paras, blocks, error): one row per page, text held once."""
    return _read(pages, links=False)


def unreadable(pages: DataFrame) -> DataFrame:
    """Pages without HTML and pages the reader gave up on, with the reason; they yield no links and no blocks."""
    return _read(pages, links=False).filter("error is not null").select("page_id", "url", "error")


def _read(pages: DataFrame, links: bool) -> DataFrame:
    wanted = f"links array<{LINK}>" if links else (
        f"pieces array<string>, paras array<{PARA}>, blocks array<{BLOCK}>"
    )
    schema = T.StructType.fromDDL(f"page_id bigint, url string, {wanted}, error string")
    return pages.select("page_id", "url", "html").mapInArrow(_reader(schema, links), schema)


def _reader(schema: T.StructType, links: bool):
    arrow_schema, read_page = to_arrow_schema(schema), markup.read_page
    rules = {**_RULES, "only_links": links, "tags": {}}  # with the start tags a task has seen
    names = ("links",) if links else ("pieces", "paras", "blocks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # small output batches, pages can be large
                rows = batch.slice(start, 64)
                found, errors = [], []
                for url, html in zip(rows["url"].to_pylist(), rows["html"].to_pylist()):
                    error = "no HTML" if html is None else None
                    try:
                        facts = read_page(url or "", html or "", rules)
                    except Exception as problem:  # one bad page never fails the job
                        facts, error = None, f"{type(problem).__name__}: {problem}"
                    found.append(facts)
                    errors.append(error)
                lists = [_list_column([f and getattr(f, n) for f in found], arrow_schema.field(n).type) for n in names]
                columns = [rows["page_id"], rows["url"], *lists, pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return read


def _list_column(lists: list[list | None], kind: pa.ListType) -> pa.Array:
    """One list for each page, null for None; structs are given as sequences in the order of their fields."""
    flat, offsets = [], []
    for values in lists:
        offsets.append(None if values is None else len(flat))
        flat += values or ()
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), _column(flat, kind.value_type), type=kind)


def _column(values: list | tuple, kind: pa.DataType) -> pa.Array:
    """Values column by column: an Arrow array from a dict for each struct takes several times as long."""
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    missing = [v is None for v in values]
    if any(missing):
        none = (None,) * kind.num_fields
        values = [none if v is None else v for v in values]
    columns = zip(*values) if values else [()] * kind.num_fields
    arrays = [_column(column, field.type) for column, field in zip(columns, kind)]
    return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array(missing, pa.bool_()) if any(missing) else None)


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(url, loc_ix, loc): the ``<loc>`` texts of each sitemap, broken XML included."""
    found = F.regexp_extract_all("xml", F.lit(r"(?is)<loc(?:\s[^>]*)?>([^<]*)</loc>"), 1)
    plain = _numbered_entities(F.col("raw"))
    for entity, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return (
        sitemaps.select("url", F.posexplode(found).alias("loc_ix", "raw"))
        .select("url", "loc_ix", strip(plain).alias("loc"))
    )


def _numbered_entities(text):
    """Character references by number (``&#233;``, ``&#xE9;``) as characters; an ampersand stays ``&amp;`` for the named ones."""

    def character(code):
        return F.when(code == 38, F.lit("&amp;")).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        )

    def replaced(done, entity):
        digits = F.substring(entity, F.lit(3), F.length(entity) - 3)
        code = F.when(
            F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)
        ).otherwise(digits)
        code = code.cast("long")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.replace(done, entity, character(code))).otherwise(done)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    return F.when(F.contains(text, F.lit("&#")), F.aggregate(found, text, replaced)).otherwise(text)


def sitemap_url(site_url):
    """Where the sitemap of a site is expected."""
    return F.concat(scheme(site_url), F.lit("://"), host(site_url), F.lit("/sitemap.xml"))
