"""New page snapshots into the activity table, each snapshot once."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from affiche.plans.load import load_activities
from affiche.sources.pages import SNAPSHOT


def load_snapshots(
    spark: SparkSession,
    snapshots: str,
    sites: DataFrame,
    store: str,
    checkpoint: str,
    as_of: dt.date | None = None,
    sitemaps: DataFrame | None = None,
) -> StreamingQuery:
    """Take every snapshot file not seen yet through the build into ``store``, then stop.

    One run is one crawl: all new files form one micro-batch. Which agenda pages a site page led to is kept
    beside the store (``<store>-agenda``), so agenda pages may come in a later run. The first run over an empty store is the
    backfill. A batch replayed after a failure rewrites its own load (see ``store``); loads are named by the
    stream's own id, which Spark keeps in the checkpoint, so another stream or a fresh checkpoint
    never writes over what is stored.
    """
    stream = spark.readStream.schema(SNAPSHOT).format("parquet").load(snapshots)

    def load(pages: DataFrame, batch_id: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        load_activities(pages, sites, store, f"{stream_id}-{batch_id:09d}", as_of, sitemaps, agenda_path=f"{store.rstrip('/')}-agenda")

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
