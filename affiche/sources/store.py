"""The activity table as Parquet: create, read, add what is new, tidy up.

Every load writes folders of its own and is then listed in a new version of the table (see ``manifest``): its rows, the
hashes of their keys, and how many rows each category and city has. What is not listed is not there: a
load killed half-way is invisible, and readers may stay on a version. A load that is run again, after a lost
driver or a replayed micro-batch, takes its own place in the list and compares itself with the other loads
only, so nothing is stored twice, undated rows included. One writer at a time by contract.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affiche.operators.dedup import CRAWL_ORDER, first_per
from affiche.schema import ACTIVITY, KEY, NEW_ACTIVITY, REQUIRED
from affiche.sources import manifest
from affiche.sources.manifest import Load, Version
from affiche.sources.settle import written

CLUSTER = ["category", "city", "event_date", "id"]
#: What goes with each folder of rows: key hashes in order, and counts; both carry the folder's name.
KEYS = "key_hash long, folder string"
CELLS = "category string, city string, n long, folder string"
#: A folder of fewer rows is worth merging with others.
SMALL = 1_000_000


def init_store(spark: SparkSession, path: str) -> None:
    """Create the table if the path holds none."""
    if not manifest.numbers(spark, path):
        manifest.publish(spark, path, 1, [])


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored activities; filters on category, city and event_date skip files and row groups.

    The rows are those of the newest version when this is called, or of the given one; later loads change nothing.
    """
    return _rows(spark, path, manifest.read(spark, path, version).loads)


def read_load(spark: SparkSession, path: str, load_id: str) -> DataFrame:
    """What one load added; a load that was merged with others comes with theirs."""
    return _rows(spark, path, [load for load in manifest.read(spark, path).loads if load_id in load.load_ids])


def _rows(spark: SparkSession, path: str, loads: tuple[Load, ...] | list[Load]) -> DataFrame:
    held = [load for load in loads if load.rows]
    if not held:
        return spark.createDataFrame([], ACTIVITY).limit(0)  # known to be empty when a join with it is planned
    return spark.read.schema(ACTIVITY).parquet(*[f"{path}/rows/{load.folder}" for load in held])


def _beside(spark: SparkSession, path: str, part: str, schema: str, loads: list[Load]) -> DataFrame:
    """The key hashes or the counts of some loads, with the name of the folder each belongs to."""
    if not loads:
        return spark.createDataFrame([], schema)
    base = f"{path}/{part}"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/folder={load.folder}" for load in loads])


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether the table holds no row: from the list of loads, no data is read."""
    return manifest.read(spark, path).rows == 0


def cells(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(category, city, n): rows of each pair, added up from the counts that were kept with each load."""
    loads = [load for load in manifest.read(spark, path, version).loads if load.rows]
    return _beside(spark, path, "cells", CELLS, loads).groupBy("category", "city").agg(F.sum("n").alias("n"))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with a null in a required column are left out, as an ignoring insert does."""
    return df.na.drop(subset=REQUIRED)


def insert_if_absent(
    batch: DataFrame, stored: DataFrame, null_safe: bool = False, order: list[str] | None = None
) -> DataFrame:
    """What an ignoring insert of ``batch`` would add to ``stored``: first row per key, if not stored.

    An undated row equals no other row unless ``null_safe``. Undated rows therefore
    pass by the dedup and the join, where they would pile up on the partitions of
    their titles. Both ways read the batch, so hand in a settled one if it is costly.
    """
    batch = complete_rows(batch)
    order = order or [name for name in NEW_ACTIVITY.names if name not in KEY]
    # Led by a number, the sorts behind the window and the join hardly ever compare two texts.
    by = ["__key_hash", *KEY]
    if "__key_hash" not in batch.columns:
        batch = batch.withColumn("__key_hash", key_hash())
    keys = stored.select(key_hash().alias("__key_hash"), *KEY)
    if null_safe:
        b, s = first_per(batch, by, order).alias("b"), keys.alias("s")
        same = [F.col(f"b.{name}").eqNullSafe(F.col(f"s.{name}")) for name in by]
        return b.join(s, same, "left_anti").drop("__key_hash")
    undated = F.col("event_date").isNull()
    dated = first_per(batch.filter(~undated), by, order)
    fresh = dated.join(keys.filter(~undated), by, "left_anti")
    return fresh.unionByName(batch.filter(undated)).drop("__key_hash")


def with_ids(batch: DataFrame, last_id: int) -> DataFrame:
    """Dense ids after ``last_id``, in the order of ``__at``, which a written batch has from ``monotonically_increasing_id``.

    The upper bits of ``__at`` are the task that wrote the row, the lower 33 its number there. Two passes: rows per
    task (one small row each, from one column), then an offset per task. No global sort and no single task over the rows.
    """
    part = F.shiftright("__at", 33)
    per_part = batch.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = F.coalesce(
        F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = per_part.select("__part", "__first", before.alias("__before"))
    return (
        batch.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per task of the batch
        .withColumn("id", last_id + 1 + F.col("__before") + F.col("__at") - F.col("__first"))
        .drop("__part", "__at", "__first", "__before")
    )


def key_hash() -> Column:
    """The hash under which a row's key is looked up. Equal keys have equal hashes; others hardly ever."""
    return F.xxhash64(*KEY)


def loads_with(spark: SparkSession, path: str, loads: list[Load], keys: DataFrame) -> list[Load]:
    """The loads in which a row has one of the hashes of ``keys`` (``__key_hash``). Hashes are read, stored rows are not.

    The driver is told names of folders, never more than there are loads.
    """
    held = [load for load in loads if load.rows]
    if not held:
        return []
    stored = _beside(spark, path, "keys", KEYS, held)
    hit = stored.join(keys.select(F.col("__key_hash").alias("key_hash")).distinct(), "key_hash", "left_semi")
    names = {r["folder"] for r in hit.select("folder").distinct().collect()}
    return [load for load in loads if load.folder in names]


def _write(spark: SparkSession, path: str, rows: DataFrame, load_ids: tuple[str, ...]) -> Load:
    """Write a folder of rows and what goes with it; it counts once a version lists it."""
    folder = f"{quote(load_ids[-1], safe='')}-{uuid.uuid4().hex[:12]}"
    (
        rows.select(*ACTIVITY.names)
        # ranges end in the id, so a city that holds a third of the rows is still split
        .repartitionByRange(*CLUSTER)
        .sortWithinPartitions(*CLUSTER)
        .write.parquet(f"{path}/rows/{folder}")
    )
    stored = spark.read.schema(ACTIVITY).parquet(f"{path}/rows/{folder}")
    day = F.col("event_date")
    counts = stored.groupBy("category", "city").agg(
        F.count("*").alias("n"), F.max("id").alias("last_id"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    counts.coalesce(1).write.parquet(f"{path}/cells/folder={folder}")  # one row a category and city
    counted = spark.read.schema(counts.schema).parquet(f"{path}/cells/folder={folder}")
    n, last_id, first_day, last_day = counted.agg(F.sum("n"), F.max("last_id"), F.min("first_day"), F.max("last_day")).first()
    if n:
        hashes = stored.select(key_hash().alias("key_hash")).distinct()
        hashes.sortWithinPartitions("key_hash").write.parquet(f"{path}/keys/folder={folder}")
    return Load(folder, load_ids, n or 0, last_id or 0, first_day, last_day)


def append(
    path: str, batch: DataFrame, load_id: str, null_safe: bool = False, order: list[str] | None = None
) -> int:
    """Store the new rows of a batch under ``load_id``; returns how many were stored.

    The batch is worked out once and written with the place and the key hash of each row, so ids and the date window below
    rest on the same rows even when executors are lost, and each step reads only the columns it needs. Of rows with one key the first is stored, by the
    ``order`` columns of the batch (the crawl order where it has one), then by place in the batch. Rows that turn out to
    be stored already leave gaps in the ids. Only loads of the same days that hold the hash of an offered key are
    read. A load that was merged with others (``compact``) cannot be run again: that raises an error.
    """
    spark = batch.sparkSession
    init_store(spark, path)
    before = manifest.read(spark, path)
    if any(load_id in load.load_ids and len(load.load_ids) > 1 for load in before.loads):
        raise ValueError(f"load {load_id} has been merged with others and cannot be run again")
    others = [load for load in before.loads if load_id not in load.load_ids]
    if order is None:
        order = CRAWL_ORDER if set(CRAWL_ORDER) <= set(batch.columns) else []
    beside = [name for name in dict.fromkeys(order) if name not in NEW_ACTIVITY.names]
    rows = written(
        complete_rows(batch)
        .select(*NEW_ACTIVITY.names, *beside)
        .withColumns({"__at": F.monotonically_increasing_id(), "__key_hash": key_hash()})
    )

    first_day, last_day = rows.agg(F.min("event_date"), F.max("event_date")).first()
    # Only stored rows of the same days can hold the same key: other loads and older files are skipped.
    same_days = [load for load in others if null_safe or _overlaps(load, first_day, last_day)]
    offered = rows if null_safe else rows.filter(F.col("event_date").isNotNull())
    in_window = F.col("event_date").between(first_day, last_day)
    rivals = _rows(spark, path, loads_with(spark, path, same_days, offered))
    rivals = rivals.filter((in_window | F.col("event_date").isNull()) if null_safe else in_window)
    last_id = max((load.last_id for load in others), default=0)
    # Numbers follow the place in the batch, so they settle what the order leaves open.
    numbered = with_ids(rows, last_id).withColumnRenamed("id", "__id")
    fresh = insert_if_absent(numbered, rivals, null_safe, order=[*order, "__id"]).withColumnRenamed("__id", "id")

    stored = _write(spark, path, fresh.withColumn("created_at", F.current_timestamp()), (load_id,))
    manifest.publish(spark, path, before.number + 1, [*others, stored])
    return stored.rows


def _overlaps(load: Load, first_day: str | None, last_day: str | None) -> bool:
    return None not in (load.first_day, first_day) and load.first_day <= last_day and first_day <= load.last_day


def compact(spark: SparkSession, path: str, small: int = SMALL, keep: int = 2) -> Version:
    """Merge the folders of fewer than ``small`` rows into one and list that instead of them.

    The ``keep`` newest loads stay as they are, because a load may be run again while it is new. Rows, ids and load times do not
    change, nor does what older versions list; ``manifest.remove`` deletes what no version lists any more.
    """
    now = manifest.read(spark, path)
    little = [load for load in now.loads[: len(now.loads) - keep] if load.rows < small]
    if len(little) < 2:
        return now
    names = tuple(name for load in little for name in load.load_ids)
    merged = _write(spark, path, _rows(spark, path, little), names)
    rest = [load for load in now.loads if load not in little]
    return manifest.publish(spark, path, now.number + 1, [merged, *rest])
