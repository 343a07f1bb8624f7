"""Which folders make up a store, version by version.

A version is one small file that lists the loads: folder, rows, last id, days. It appears under its final name
at once, so a reader sees a load wholly or not at all, and a reader that names a version always sees the same rows.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Load(NamedTuple):
    """One folder of rows: the loads in it, and what is known of its rows without reading them."""

    folder: str
    load_ids: tuple[str, ...]
    rows: int
    last_id: int
    first_day: str | None = None
    last_day: str | None = None


class Version(NamedTuple):
    number: int
    loads: tuple[Load, ...]

    @property
    def rows(self) -> int:
        return sum(load.rows for load in self.loads)

    @property
    def last_id(self) -> int:
        return max((load.last_id for load in self.loads), default=0)


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the folder of its versions there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, oldest first."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))


def read(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, the newest if no number is given."""
    known = numbers(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no version {'' if number is None else number} of a store at {path}")
    number = known[-1] if number is None else number
    text = spark.read.text(f"{path}/{FOLDER}/v{number:09d}.json", wholetext=True).first()[0]
    loads = [Load(**{**entry, "load_ids": tuple(entry["load_ids"])}) for entry in json.loads(text)]
    return Version(number, tuple(loads))


def publish(spark: SparkSession, path: str, number: int, loads: list[Load]) -> Version:
    """Make ``loads`` version ``number``. One writer at a time: a version that is there already is an error."""
    files, where = _files(spark, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    final, draft = new_path(where, f"v{number:09d}.json"), new_path(where, f".draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(json.dumps([load._asdict() for load in loads]).encode())
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise FileExistsError(f"version {number} of the store at {path} was written by another writer")
    return Version(number, tuple(loads))


def remove(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Forget all versions but the ``keep`` newest, and delete the folders that no version lists; returns those."""
    known = numbers(spark, path)
    files, where = _files(spark, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    for number in known[:-keep]:
        files.delete(new_path(where, f"v{number:09d}.json"), False)
    listed = {load.folder for number in known[-keep:] for load in read(spark, path, number).loads}
    gone = []
    for part in ("rows", "keys", "cells"):
        held = new_path(f"{path}/{part}")
        for status in files.listStatus(held) if files.exists(held) else ():
            name = status.getPath().getName().removeprefix("folder=")
            if name not in listed:
                files.delete(status.getPath(), True)
                gone += [name] if part == "rows" else []
    return sorted(gone)
