"""Page snapshots in buckets by URL: they meet agendas of any size without their HTML being shuffled.

A join with an agenda beyond the broadcast limit sorts and merges both sides by URL. Where the snapshots lie in
buckets of the URL's hash already, only the agenda (short rows) is dealt; the HTML is read where it lies, with one
task a bucket. The same holds for picking the newest snapshot of each URL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from affiche.sources.pages import SNAPSHOT, newest, successful


def _table(location: str, buckets: int) -> str:
    return f"snapshots_{hashlib.md5(f'{buckets} {location}'.encode()).hexdigest()}"


def open_bucketed(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    """The snapshots at ``location``, which were written with as many ``buckets``; none yet is an empty table.

    The session's catalog learns of the folder here; the folder itself holds everything else. Failed fetches
    and older snapshots are still among the rows (``current`` leaves them out).
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SNAPSHOT)
    place = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(location, buckets)} ({columns}) USING parquet "
        f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(_table(location, buckets))


def add_snapshots(pages: DataFrame, location: str, buckets: int) -> None:
    """Add the newest successful snapshot of each URL of a crawl; the one shuffle of HTML there is.

    ``buckets`` should be no less than the session's shuffle partitions, else Spark prefers to deal both sides anew,
    and large enough for a bucket's HTML to fit a task; it stays the same for a location. One row a URL is
    written for each crawl, so a page fetched over and over does not fill a bucket.
    """
    open_bucketed(pages.sparkSession, location, buckets)
    rows = newest(successful(pages))
    missing = [f for f in SNAPSHOT if f.name not in rows.columns]
    rows = rows.selectExpr(*rows.columns, *(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in missing))
    (
        rows.select(*SNAPSHOT.names)
        .repartition(buckets, "url")  # the hash of the buckets: one file a bucket
        .write.bucketBy(buckets, "url")
        .sortBy("url")
        .format("parquet")
        .option("path", location)
        .mode("append")
        .saveAsTable(_table(location, buckets))
    )


def current(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    """(page_id, url, html): each page as it was fetched last."""
    return newest(successful(open_bucketed(spark, location, buckets))).select("page_id", "url", "html")
